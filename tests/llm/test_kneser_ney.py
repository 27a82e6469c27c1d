import random

import numpy as np

from neurosheaf.llm import kneser_ney as k

SCHEMA = "doc_id long, text string, lang string, kept string, threshold string"


def texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["the", "of", "and", "river", "stone", "été", "42"], k=rng.randint(1, 30))) + "." for _ in range(n)]


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(4)
    rows = [(i, t, "en") for i, t in enumerate(texts(600))]
    rows += [(1000 + i, "".join(rng.choices("#$%zqxj9@", k=200)), "en") for i in range(30)] + [(2000, None, "en"), (2001, "", None), (2002, "anything", "xx"), (2003, "##$$ zq", "en"), (None, "the river", "en")]
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = k.classify(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[1000 + i] for i in range(30)) and kept[2000] and kept[2001] and kept[2002]
    assert np.mean([kept[i] for i in range(300, 600)]) > 0.97
    assert {(r.doc_id, r.kept) for r in k.classify_ids(docs, labels).collect()} == {(r.doc_id, r.kept) for r in got}


def test_without_trusted_text_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", "y")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in k.classify(docs, none).collect()] == [True]
    assert k.classify(docs.limit(0), none).count() == 0
