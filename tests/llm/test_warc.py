import gzip
import hashlib
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurosheaf.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first int, id string"


def pieces(data: bytes):
    """What Spark's text reader gives for a file whose lines end with END."""
    parts = data.split(warc.END)
    return parts[:-1] if parts[-1] == b"" else parts


def check(rows, got):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    seen = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        known = [x for x in groups[b] if x is not None]
        first = min(known) if known and len(b) >= 100 and len(groups[b]) > 1 else None
        again = first is not None and first != i
        want.append((i is None, i or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert seen == sorted(want, key=lambda w: tuple(x if x is not None else -1 for x in w)) or sorted(map(str, seen)) == sorted(map(str, want))


def test_round_trip_of_odd_pages(spark):
    rng = random.Random(0)
    hard = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n"
    big = "".join(chr(rng.choice([97, 233, 13, 10, 0x1F389])) for _ in range(60_000))
    rows = [(1, "http://a/", hard * 50), (2, "http://b/\r\nX: y", hard * 50), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "\r\n" * 300), (8, "u", big), (9, "u", big), (10, "u", "\r\n\r\n" * 4000 + "z"), (0, "u", big), (11, "u", "r\r"), (12, "u", "y" * 16_000), (13, "u", "y" * 32_768)]
    pages = spark.createDataFrame([(*r, "d", 1, "i") for r in rows], SCHEMA)
    got = warc.round_trip(pages).collect()
    assert not any(r.problem for r in got)
    check(rows, got)


def test_repeated_and_missing_ids(spark):
    big = "long text " * 5000
    rows = [(1, "u", big), (1, "u", big), (1, "u", "other " * 9000), (None, "u", big), (None, "u", "lonely " * 7000), (2, "u", big)]
    got = warc.round_trip(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert not any(r.problem for r in got)
    check(rows, got)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_plain_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "abc" * 20_000, None, None, None) for i in range(3)], SCHEMA)
    warc.write_archives(pages, f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(f"{tmp_path}/w").glob("part-*")))
    found = list(warc.parse(pieces(data)))
    assert all(problem is None for _, _, problem in found)
    kinds = [f["warc-type"] for f, _, _ in found]
    assert kinds.count("response") == 1 and kinds.count("revisit") == 2 and kinds.count("continuation") >= 3
    read = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, f"{tmp_path}/w").where("kind = 'response'").collect()}
    assert read == {"urn:page:0": b"abc" * 20_000}


def test_segments_in_any_order_and_broken_ones(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 50, 7)
    parts = [block[i : i + 100] for i in range(0, len(block), 100)]
    names = [x.split()[0] for x in warc._RECORD.split(", ")]

    def rows(origin, order, total):
        return [(None, origin, "response" if n == 0 else "continuation", None, None, None, None, n + 1, total if n == len(parts) - 1 else None, parts[n], None) for n in order]

    n = len(parts)
    table = rows("whole", reversed(range(n)), len(block)) + rows("twice", [*range(n), 1], len(block)) + rows("gap", [i for i in range(n) if i != 1], len(block)) + rows("short", range(n), 5) + rows("headless", range(1, n), len(block))
    df = spark.createDataFrame(table, warc._RECORD)
    got = {r.origin: r for r in warc.reassemble(df.select(names)).collect()}
    assert bytes(got["whole"].block) == bytes(got["twice"].block) == block and got["whole"].problem is None
    assert warc.http_payload(block) == b"payload" * 50
    assert got["gap"].problem == got["headless"].problem == "segment is missing" and got["short"].problem == "total length isn't met"


@pytest.mark.parametrize("body", [b"", b"5\r\nab", b"x\r\n", b"2\r\nabc\r\n0\r\n\r\n", b"-1\r\n\r\n"])
def test_broken_chunks(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"a", b"WARC/1.1\r\n"]), max_size=8), max_size=6))
def test_parse_any_blocks(blocks):
    blocks = [b"".join(b) for b in blocks]
    data = b"".join(warc._head(WARC_Type="resource", Content_Length=len(b)) + b + warc.END for b in blocks)
    got = list(warc.parse(pieces(data)))
    assert [b for _, b, _ in got] == blocks and all(p is None for _, _, p in got)


def test_garbage_is_passed_over():
    good = warc._head(WARC_Type="resource", Content_Length=2) + b"ok" + warc.END
    got = list(warc.parse(pieces(b"junk" + warc.END + good + warc._head(WARC_Type="resource") + good + warc._head(WARC_Type="resource", Content_Length=99) + b"cut")))
    assert [b for _, b, p in got if p is None] == [b"ok", b"ok"] and [p for _, _, p in got if p] == ["no content length", "record is cut short"]
