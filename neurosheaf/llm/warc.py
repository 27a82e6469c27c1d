"""WARC archives: segmented, chunked and deduplicated records written and read by Spark.

A record is one value of Spark's text writer with the separator that ends WARC records, so archives
are ordinary files in any store that Spark writes to (gzip-compressed ones, which are read from their
start). Reading takes the bytes back in order, task by task, and cuts records by their lengths.
Records in segments are put together by Spark: grouped by the identifier of their origin, ordered by
segment number and checked against the total length before the chunked transfer framing is decoded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, shared_dir

END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Blocks of more bytes are cut into segments; chunks of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: The first pages of groups of equal payloads are broadcast up to so many (about 80 bytes each).
BROADCAST_FIRSTS = 50_000
_URN = "urn:page:"
_RECORD = "record_id string, origin string, kind string, url string, refers_to string, digest string, payload_bytes long, number int, total long, block binary, problem string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[at : at + size]), p) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("chunk size is negative")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response: its body, unchunked if it says so."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no end of HTTP headers")
    fields = _fields(head.split(b"\r\n")[1:])
    return unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines)
    return {k.strip().decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _head(**fields) -> bytes:
    lines = ["WARC/1.1", *(f"{k.replace('_', '-')}: {' '.join(str(v).split())}" for k, v in fields.items() if v is not None)]
    return "\r\n".join(lines).encode() + END


def records(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int) -> Iterator[bytes]:
    """The records of a page, each without its end: one, or a first segment and its continuations."""
    common = {"WARC_Date": DATE, "WARC_Target_URI": url, "Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": f"sha256:{digest}"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = {"WARC_Type": "revisit", "WARC_Record_ID": f"<{record_id}>", **common, "WARC_Profile": profile, "WARC_Refers_To": f"<{refers_to}>", "X_Payload_Length": len(payload)}
        yield _head(**fields, Content_Length=len(http)) + http
        return
    block = http + chunked(payload)
    if len(block) <= segment:
        yield _head(WARC_Type="response", WARC_Record_ID=f"<{record_id}>", **common, Content_Length=len(block)) + block
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        total = len(block) if n == len(parts) else None
        if n == 1:
            yield _head(WARC_Type="response", WARC_Record_ID=f"<{record_id}>", **common, WARC_Segment_Number=1, Content_Length=len(part)) + part
        else:
            own = f"<{record_id}:segment-{n}>"
            yield _head(WARC_Type="continuation", WARC_Record_ID=own, WARC_Date=DATE, WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total, Content_Length=len(part)) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, segment: int = SEGMENT_BYTES) -> None:
    """Writes a record for every row to gzip-compressed archives under ``path``.

    Null payloads are empty. Of rows with equal payloads of at least ``least`` bytes, those with the
    least id are responses and the others revisit it. Null ids take part: such rows are revisits where
    some equal row has an id. Ids that repeat get records of their own. Other columns aren't archived.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = cut(groups.where("n > 1 and first is not null").select(F.col("digest").alias("_digest"), "first"))
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_FIRSTS else dealt(firsts)
    repeated = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("_id")))
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_FIRSTS else dealt(repeated)
    placed = rows.join(firsts, F.col("digest") == F.col("_digest"), "left").join(repeated, F.col("id").eqNullSafe(F.col("_id")), "left")
    name = F.concat(F.lit(_URN), F.coalesce(F.col("id").cast("string"), F.lit("")))
    own = F.when(F.col("id") == F.col("_id"), F.concat(name, F.lit(":"), F.uuid())).when(F.col("id").isNull(), F.concat(name, F.lit(":"), F.uuid())).otherwise(name)
    refers = F.when(~F.col("first").eqNullSafe(F.col("id")), F.concat(F.lit(_URN), F.col("first").cast("string")))
    ready = placed.select(own.alias("record_id"), "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        for b in batches:
            out, size = [], 0
            for record_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records(record_id, url, payload, digest, refers_to, segment):
                    out.append(r)
                    size += len(r)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    written = ready.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(fields, block, problem) of each record of archives whose bytes are the pieces, each followed by END.

    After bytes that are no record, reading goes on at the next piece that begins one.
    """
    pieces, held = iter(pieces), b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        if piece is None:
            return False
        held = held + piece + END if held else piece + END
        return True

    while held or more():
        at = held.find(END)
        if not held.startswith(b"WARC/"):
            held = held[at + 4 :] if at >= 0 else b""
            continue
        fields = _fields(held[:at].split(b"\r\n")[1:])
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield fields, None, "no content length"
            held = held[at + 4 :]
            continue
        start, end = at + 4, at + 4 + int(length)
        if len(held) < end + 4:
            parts, size = [held], len(held)
            while size < end + 4 and (piece := next(pieces, None)) is not None:
                parts += [piece, END]
                size += len(piece) + 4
            held = b"".join(parts)
        if held[end : end + 4] != END:
            yield fields, None, "record is cut short"
            held = held[start:]
            continue
        yield fields, held[start:end], None
        held = held[end + 4 :]


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The response, revisit and continuation records of archives: those in segments, or the others. Blocks of revisits are left out."""

    def run(batches):
        def pieces():
            for b in batches:
                yield from (x.as_py() for x in b.column(0).cast(pa.binary()))

        def batch(rows):
            kinds = [pa.string()] * 6 + [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            names = [x.split()[0] for x in _RECORD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        rows, size = [], 0
        for f, block, problem in parse(pieces()):
            kind, number = f.get("warc-type"), _number(f.get("warc-segment-number"))
            if kind not in {"response", "revisit", "continuation"} or (number is not None) != segmented:
                continue
            own = _bare(f.get("warc-record-id"))
            digest = (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None
            rows.append(
                (own, _bare(f.get("warc-segment-origin-id")) or own, kind, f.get("warc-target-uri"), _bare(f.get("warc-refers-to")), digest, _number(f.get("x-payload-length")), number, _number(f.get("warc-segment-total-length")), None if kind == "revisit" else block, problem)
            )
            size += len(block or b"")
            if size > 8 << 20 or len(rows) >= 5000:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)

    lines = spark.read.option("lineSep", END.decode()).text(path)
    return lines.mapInArrow(run, _RECORD)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each origin: segments in order of their numbers, put together; a problem if any is missing or the total length isn't met.

    A segment archived twice counts once. A group is one page, so no task gathers more than a page at a time.
    """
    once = F.array_sort(F.collect_list(F.struct("number", "kind", "url", "digest", "total", "block", "problem")))
    grouped = segments.groupBy("origin").agg(once.alias("s"))
    ordered = F.filter("s", lambda x, i: (i == 0) | (x["number"] != F.get(F.col("s"), i - 1)["number"]))
    grouped = grouped.withColumn("s", ordered)
    first = F.get("s", F.lit(0))
    total = F.array_max(F.transform("s", lambda x: x["total"]))
    block = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["block"], F.lit(b""))))
    gapless = (first["number"] == 1) & (F.get("s", F.size("s") - 1)["number"] == F.size("s"))
    joined = grouped.select("origin", first.alias("f"), "s", gapless.alias("gapless"), total.alias("total"), block.alias("block"))
    problem = (
        F.when(F.exists("s", lambda x: x["problem"].isNotNull()), "record is cut short")
        .when(~F.col("gapless"), "segment is missing")
        .when(F.col("total").isNull() | (F.col("total") != F.octet_length("block")), "total length isn't met")
    )
    none = F.lit(None).cast("string")
    return joined.select(
        F.col("origin").alias("record_id"), "origin", F.coalesce("f.kind", F.lit("response")).alias("kind"), "f.url", none.alias("refers_to"), "f.digest", F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("int").alias("number"), "total", "block", problem.alias("problem")
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, url, refers_to, digest, payload_bytes, payload, problem): a row for each response and revisit.

    The payload of a response is decoded and held against its digest; a revisit has none, and its
    length and digest as written. problem is null for a sound record. An archive without records gives no rows.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]
    found = read_records(spark, path, False).select(names).union(reassemble(read_records(spark, path, True)).select(names))

    def run(batches):
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            payloads, sizes, problems = [], c["payload_bytes"].to_pylist(), c["problem"].to_pylist()
            for i, (kind, block, digest) in enumerate(zip(c["kind"].to_pylist(), c["block"], c["digest"].to_pylist(), strict=True)):
                payload = None
                if kind == "response" and problems[i] is None:
                    try:
                        payload = http_payload(block.as_py() or b"")
                        sizes[i] = len(payload)
                        if digest and hashlib.sha256(payload).hexdigest() != digest:
                            problems[i] = "digest isn't met"
                    except ValueError as e:
                        problems[i] = str(e)
                payloads.append(payload)
            arrays = [c["record_id"], c["kind"], c["url"], c["refers_to"], c["digest"], pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["record_id", "kind", "url", "refers_to", "digest", "payload_bytes", "payload", "problem"])

    return found.mapInArrow(run, "record_id string, kind string, url string, refers_to string, digest string, payload_bytes long, payload binary, problem string")


def page_of(urn: Column) -> Column:
    """The page id in a record's identifier."""
    return F.nullif(F.regexp_extract(urn, rf"^{_URN}(-?\d+)", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives all pages in the shared folder and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, problem).

    A null or empty html is a payload of no bytes, and a null url an empty one. Other columns of ``pages`` don't matter.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    read = read_archives(pages.sparkSession, path)
    digest = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("digest"))
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("kind").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "problem")
