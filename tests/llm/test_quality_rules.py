import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from neurosheaf.llm import quality_rules as q

SCHEMA = "doc_id long, lang string, text string, kept string, n_words string, stratum string"


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(0)
    out = [None, "", " ", "\n\n", "a\na\na", "a b c a b c", "é ü\xa0x\u2003y #*$%&|<>", "a a a a", "word " * 50_000, " ".join(f"u{i}" for i in range(30_000)), "l\n" * 3000, "\x0b\x0c\r\t a"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "c", "d", " ", " ", "\n", "#"]) for _ in range(rng.randint(1, 400))))
    return out


def test_features_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, None, t, "x", "y", "z") for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.features(docs).collect()}
    for i, t in enumerate(rows):
        assert got[i] == brute(t), (t or "")[:60]


def binomial(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


@pytest.mark.parametrize("p", [0.0025, 0.05])
def test_binomial_is_exact(spark, p):
    cases = [(k, n) for n in (1, 10, 500, 4000) for k in (0, 1, 2, 5, 9, 40, 150) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("c", q.binomial_cdf(F.col("k"), F.col("n"), p))
    for r in df.collect():
        if r.k < r.n * p:
            assert r.c == pytest.approx(binomial(r.k, r.n, p), rel=1e-9)
        else:
            assert r.c == 1.0


def test_thresholds_are_valid_and_strata_without_labels_keep_all(spark):
    rng = random.Random(1)
    good = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
    junk = lambda: " ".join(rng.choice(["#$%", "***", "ab|"]) for _ in range(100))
    rows = [(i, "en", good()) for i in range(3000)] + [(i, "en", junk()) for i in range(3000, 3100)] + [(4000, None, junk()), (4001, "xx", good()), (4001, "xx", good()), (4002, "en", None)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(i, 0) for i in range(3000, 3100)] + [(None, None), (5, None), (5, 1)], "doc_id long, quality int")
    got = q.judge(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 3000)
    assert not any(r.kept for r in got if r.doc_id is not None and (3000 <= r.doc_id < 3100 or r.doc_id == 4002))
    assert [r.kept for r in got if r.doc_id == 4001] == [True, True]
    slim = q.judge_ids(docs.select("doc_id", "lang", "text"), labels)
    assert {(r.doc_id, r.kept) for r in slim.collect()} == {(r.doc_id, r.kept) for r in got}


def test_false_rejections_stay_below_alpha(spark):
    """On new documents of the same kind, the accepted cutoffs reject at most a share of alpha, with the stated confidence."""
    rng = random.Random(2)
    make = lambda: " ".join(rng.choice(["#x"] * 3 + [f"w{rng.randrange(900)}" for _ in range(7)]) if rng.random() < 0.1 else f"w{rng.randrange(900)}" for _ in range(60))
    docs = spark.createDataFrame([(i, "en", make()) for i in range(6000)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    fresh = q.judge_ids(docs, labels, alpha=0.02).where("doc_id >= 3000 and not base_failed")
    assert fresh.agg(F.avg((~F.col("kept")).cast("double"))).first()[0] <= 0.02


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert q.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_small_strata_take_the_cutoffs_of_the_pool(spark):
    rng = random.Random(3)
    good = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    junk = lambda: " ".join(rng.choice(["#$%", "***", "ab|"]) + str(rng.randrange(5000)) for _ in range(60))
    rows = [(i, ["en", "de", "fr", "es"][i % 4], good()) for i in range(2400)] + [(3000 + i, ["en", "de", "fr", "es"][i % 4], junk()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(2400)], "doc_id long, quality int")
    kept = {r.doc_id for r in q.judge(docs, labels, pooled=True).where("kept").collect()}
    assert kept == set(range(2400))
    assert q.judge(docs, labels).where("kept").count() == 2440
