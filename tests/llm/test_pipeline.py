import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from neurosheaf.llm import bpe, kneser_ney, quality_rules
from neurosheaf.llm.common import read

from .test_decontaminate import grams
from .test_similar import least_ids

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = read(spark, SF, "documents")
    bench = [r.text for r in read(spark, SF, "benchmark").collect()]
    official = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        assert len(rows) == len(after) > 0
        if name == "quality_classifier":
            kept = kneser_ney.classify_ids(read(spark, SF, "documents").select("doc_id", "lang", "text"), read(spark, SF, "labels")).where("kept")
            assert after == {r.doc_id for r in kept.collect()}
        elif name == "quality_rules":
            assert all(len(re.split(r"[\x20\x09-\x0D]+", before[i].text.strip(" \t\n\v\f\r"))) >= 50 for i in after)
        elif name == "simhash_near_dedup":
            want = set(least_ids([(i, r.text) for i, r in before.items()]).values())
            assert after >= want and len(after - want) <= 2
        elif name == "benchmark_decontamination":
            items = [grams(t) for t in bench]
            assert after == {i for i, r in before.items() if not any(len(g & grams(r.text)) >= 0.8 * len(g) for g in items)}
        else:
            assert all(r.ids == official.encode_ordinary(before[r.doc_id].text) and r.round_trip for r in rows)
        if name != "byte_bpe":
            assert docs.columns == columns


def test_run_gives_what_the_stages_give(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.where("not round_trip").count() == 0


@pytest.mark.parametrize("name", ["documents"])
def test_stages_take_odd_rows(spark, tmp_path, name):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 100_000, None, None, 1)], read(spark, SF, name).schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        stage(spark, odd.limit(0), SF).collect()
