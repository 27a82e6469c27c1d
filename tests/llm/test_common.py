"""Joins by ids, clashing names of columns, repeated rows as holdouts."""

import pytest
from pyspark.sql import functions as F

from neurosheaf.llm import common, decontaminate, hilbert, kneser_ney, licenses, quality_rules, similar, url_filter
from neurosheaf.llm.common import read

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, or did.
INNER = ["__found__", "__text__", "__lang__", "__alias__", "__host__", "__path__", "__key__", "__language__", "__words__", "__norm__", "__curve__", "__slice__", "text_key", "_key00", "_slot0", "_bits0", "_word0", "_bit0", "_alias0", "_host0", "_path0", "_text_key0", "_text_hash0", "_language0", "_words0", "_norm0", "_curve0", "_start0", "_total0", "_id0", "_hash0", "id", "item", "doc", "set_key", "key", "one"]


@pytest.mark.parametrize("most", [common.BROADCAST_IDS, 3])
@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner"])
def test_ids_by_broadcast_and_by_bitmap(spark, monkeypatch, most, how):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    monkeypatch.setattr(common, "BITMAP", 4)
    rows = [(i if i % 7 else None, f"t{i % 5}" if i % 3 else None, i, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, _slot0 int, key long")
    ids = spark.createDataFrame([(i if i % 7 else None, f"t{i % 5}" if i % 3 else None, -i) for i in range(0, 300, 11)], "a int, b string, key long").dropDuplicates(["a", "b"])
    wanted = {(r.a, r.b) for r in ids.collect()}
    got = common.by_ids(df, ids if how == "inner" else ids.drop("key"), {"a": F.col("id"), "b": F.col("text")}, how)
    want = [r[2] for r in rows if ((r[0], r[1]) in wanted) == (how != "left_anti")]
    assert sorted(r["_slot0"] for r in got.select("_slot0").collect()) == sorted(want)


def test_stages_are_the_same_when_ids_are_not_broadcast(spark, monkeypatch):
    import corpus_pipeline

    docs = read(spark, SF, "documents")
    rows = {name: sorted(r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect()) for name, stage in corpus_pipeline.STAGES[:4]}
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert rows == {name: sorted(r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect()) for name, stage in corpus_pipeline.STAGES[:4]}


def wide(df):
    return df.withColumns({c: F.lit(7).cast("long") for c in INNER if c.lower() not in {x.lower() for x in df.columns}})


def test_columns_of_inner_names_pass_through(spark):
    docs, labels, bench = wide(read(spark, SF, "documents")), read(spark, SF, "labels"), read(spark, SF, "benchmark")
    pages = wide(read(spark, SF, "pages"))
    axes = [hilbert.by_hash(F.col("lang"), 4), hilbert.by_hash(F.col("source"), 4)]
    rules = [url_filter.UrlRule("com", "/", "allow")]
    out = {
        "decontaminate": decontaminate.decontaminate(docs, bench),
        "keep": kneser_ney.keep(docs, labels),
        "classify": kneser_ney.classify(docs, labels),
        "judge": quality_rules.judge(docs, labels, pooled=True),
        "deduplicate": similar.deduplicate(docs),
        "shards": hilbert.hilbert_shards(docs, axes, 4, 4, F.col("doc_id")),
        "scan": licenses.scan(docs),
        "urls": url_filter.judge(pages, rules, url_filter.page_edges(pages)),
        "url table": url_filter.judge(pages, spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string"), url_filter.page_edges(pages)),
    }
    for name, df in out.items():
        rows = df.select([c for c in INNER if c in df.columns]).distinct().collect()
        assert rows and all(v == 7 for r in rows for v in r), name
        assert {c for c in INNER if c not in df.columns} == set(), name


def test_sets_that_share_a_key_are_told_apart(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i // 2) * 50 + k}" for k in range(30)) + (" end" if i % 4 == 1 else "")) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((r.id, r.component_id) for r in similar.near_duplicates(docs).collect())
    assert len({c for _, c in want}) == 30
    monkeypatch.setattr(similar, "KEY_BITS", 3)
    assert sorted((r.id, r.component_id) for r in similar.near_duplicates(docs).collect()) == want


def test_repeated_rows_and_copies_certify_nothing(spark):
    text = " ".join(f"word{i}" for i in range(80))
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")

    def accepted(rows):
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        slim = quality_rules.measure(docs).withColumn("h", F.xxhash64("text"))
        return quality_rules.thresholds(slim, labels, text_hash="h").count()

    assert accepted([(1, "en", text)] * 3000) == 0
    assert accepted([(i, "en", text) for i in range(3000)]) == 0
    assert accepted([(i, "en", f"{text} {i}") for i in range(3000)]) == 4
