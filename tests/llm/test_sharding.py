import hashlib

import pytest
from pyspark.sql import functions as F

from neurosheaf.llm import hilbert

SCHEMA = "doc_id long, lang string, source string, text string, shard string, slot int, curve string"


def placed(docs, shards=4):
    axes = [hilbert.by_hash(F.col("lang"), 3), hilbert.by_hash(F.col("source"), 3), hilbert.by_log2(F.octet_length("text"), 3)]
    return hilbert.hilbert_shards(docs, axes, 3, shards, F.col("doc_id"))


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_to_neighbours(dims, bits):
    order = hilbert.hilbert_order(dims, bits)
    assert sorted(order) == list(range(1 << dims * bits))
    at = {i: cell for cell, i in enumerate(order)}
    cut = lambda c: [(c >> bits * k) & ((1 << bits) - 1) for k in range(dims)]
    for i in range(len(order) - 1):
        assert sum(abs(a - b) for a, b in zip(cut(at[i]), cut(at[i + 1]), strict=True)) == 1


def test_shards_are_runs_of_the_curve_of_equal_length(spark):
    rows = [(i, "abc"[i % 3], f"s{i % 7}", "x" * (i * 37 % 5000), "old", 1, "old") for i in range(103)]
    got = placed(spark.createDataFrame(rows, SCHEMA)).collect()
    part = lambda v: int(hashlib.md5(v.encode()).hexdigest()[:7], 16)
    order = hilbert.hilbert_order(3, 3)
    want = sorted((order[(part(r[1]) % 8) * 64 + (part(r[2]) % 8) * 8 + min(len(r[3]).bit_length(), 7)], part(str(r[0])) % hilbert.SLICES, r[0]) for r in rows)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == [w[2] for w in want]
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_nulls_ties_few_rows_and_none(spark):
    rows = [(None, None, None, None, None, None, None)] * 3 + [(1, "a", "b", "", "x", 1, "y")] * 2
    got = placed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0)]
    assert placed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert placed(spark.createDataFrame(rows[-1:], SCHEMA)).count() == 1


def test_written_shards_can_be_pruned(spark, tmp_path):
    rows = [(i, "abcd"[i // 50], f"s{i % 5}", "x" * 10, None, None, None) for i in range(200)]
    manifest = hilbert.write_shards(placed(spark.createDataFrame(rows, SCHEMA).drop("shard", "slot", "curve")), f"{tmp_path}/out").cache()
    assert manifest.agg(F.sum("rows")).first()[0] == 200
    kept = [r["shard"] for r in hilbert.prune(manifest, "lang", "a", "a").collect()]
    assert 0 < len(kept) < 4
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("shard").isin(kept) & (F.col("lang") == "a")).count() == 50
