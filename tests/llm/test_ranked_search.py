import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from neurosheaf.llm import ranked_search as search
from neurosheaf.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    n_docs, n_terms = len(found), sum(n for _, n, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, n, c in found:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "ß2", "中文", "Z"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(n)]


def got(spark, docs, items, k=20):
    index = search.Index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    rows = search.search(index, spark.createDataFrame(items, "item_id long, text string, rank int, score string"), k).collect()
    index.clear()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


@pytest.mark.parametrize(("postings", "block"), [(1 << 21, 128), (200, 4), (2000, 16)])
def test_search_equals_brute_force(spark, postings, block, monkeypatch):
    docs = corpus(700, 1) + [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, ", . -"), (903, "w1 " * 3000 + "W59 rare")]
    items = [*corpus(12, 2, 40), (50, "w0"), (51, "rare rare Rare"), (52, None), (53, ""), (54, "unknown"), (None, "w3 w3 w1"), (55, " ".join(f"w{i}" for i in range(60)))]
    # The tasks run in other processes, so what they use goes with the functions.
    index_docs = [(i, t) for i, t in docs]
    n_docs, n_terms = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "FIRST", 4)
    segments, open_ = [], search._Segment()
    for i, t in index_docs:
        open_.add(i, t.encode() if t is not None else None)
        if open_.size >= postings:
            segments, open_ = [*segments, open_], search._Segment()
    opened = [search._Opened(pa.Table.from_batches([s.rows(0, n_docs, n_terms)])) for s in [*segments, open_] if s.size]
    df = Counter(t for _, text in docs for t in set(terms(text)))
    want = brute(docs, items)
    out = []
    for item, text in items:
        weighted = [(t, n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t, n in Counter(terms(text)).items() if t in df]
        best = []
        for o in opened:
            doc, score = o.search(weighted, 20)
            best += [(-s, not o.named[d], int(o.names[d])) for d, s in zip(doc.tolist(), score.tolist(), strict=True)]
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(best)[:20], 1)]
    assert sorted(out, key=repr) == want
    if block == 128:
        assert got(spark, docs, [(i, t, 1, "x") for i, t in items]) == want


def test_blocks_below_the_threshold_stay_compressed():
    rng = random.Random(4)
    s = search._Segment()
    for i in range(6000):
        s.add(i, " ".join(["common"] * rng.randint(1, 2) + [f"x{rng.randrange(400)}" for _ in range(20)] + ["passage one two three"] * (i in range(3000, 3025))).encode())
    o = search._Opened(pa.Table.from_batches([s.rows(7, 6000, 130_000)]))
    doc, score = o.search([("common", 5), ("passage", 9000), ("one", 9000), ("two", 9000)], 20)
    assert set(doc.tolist()) <= set(range(3000, 3025)) and len(doc) == 20
    used = o.ready[o.first_block[o.at["common"]] : o.first_block[o.at["common"] + 1]]
    assert used.sum() <= 2 < len(used) == 47


def test_bytes_of_numbers():
    rng = np.random.default_rng(0)
    values = np.r_[0, 127, 128, 16383, 16384, 2**31, rng.integers(0, 1 << 40, 1000)]
    data, begin = search.packed(values)
    assert (search.unpacked(data) == values).all() and begin[1] == 1
    assert len(search.unpacked(np.zeros(0, np.uint8))) == 0


def test_empty_tables_and_parts_of_queries(spark, monkeypatch):
    docs, items = corpus(80, 5), [(i, t, 0, "") for i, t in corpus(9, 6)]
    assert got(spark, [], items) == got(spark, docs, []) == []
    monkeypatch.setattr(search, "QUERY_TERMS", 20)
    assert got(spark, docs, items, 3) == brute(docs, [x[:2] for x in items], 3)


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ["item_id", "rank", "doc_id", "score"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op13_ranked_search']})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in QUERIES["op13_ranked_search"](spark, sf).collect()) == want
