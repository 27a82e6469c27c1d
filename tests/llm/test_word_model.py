import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from neurosheaf.llm import kneser_ney, word_model as m


def tokens(text):
    return ["<s>", *m._TOKEN.findall(text.lower()), "</s>"]


def brute(train, texts):
    """Mean -ln p a token by dictionaries of words."""
    pairs = Counter(p for t in train if t for w in [tokens(t)] for p in zip(w, w[1:], strict=False))
    known = Counter(b for _, b in pairs)

    def discounts(c):
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else 0.5 for i in (1, 2, 3)]

    d1, d2 = discounts(known), discounts(pairs)
    total, lost = defaultdict(float), defaultdict(float)
    for (a, _), c in pairs.items():
        total[a] += c
        lost[a] += min(d2[min(c, 3) - 1], c)
    all_words = sum(known.values())
    uniform = sum(min(d1[min(c, 3) - 1], c) for c in known.values()) / all_words / (len(known) + 1)

    def p(a, b):
        c = known[b]
        below = (c - min(d1[min(c, 3) - 1], c) if c else 0) / all_words + uniform
        if a not in total:
            return below
        c = pairs[a, b]
        return (c - min(d2[min(c, 3) - 1], c) if c else 0) / total[a] + lost[a] / total[a] * below

    return {t: -sum(math.log(p(a, b)) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1) for t in texts if t for w in [tokens(t)]}


@pytest.mark.parametrize("head,bits,words", [(0, 1 << 28, 1 << 20), (40, 1 << 7, 0), (1 << 21, 1 << 28, 1 << 20)])
def test_scores_against_dictionaries(spark, monkeypatch, head, bits, words):
    """Also with a bitmap too small to tell much, and with the words joined by a shuffle."""
    monkeypatch.setattr(m, "HEAD", head)
    monkeypatch.setattr(m, "FILTER_BITS", bits)
    monkeypatch.setattr(m, "BROADCAST_WORDS", words)
    rng = random.Random(0)
    make = lambda: " ".join(rng.choices(["the", "of", "River", "stone", "été", "日本", "x1", *map(str, range(40))], k=rng.randint(1, 30))) + "."
    train = [make() for _ in range(60)] + [None, ""]
    texts = [make() for _ in range(20)] + ["never seen words", "the never of", " ", None, ""]
    texts += texts[:3]
    model = m.Model(spark.createDataFrame([(t,) for t in train], "text string"), kneser_ney._discounts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.where(F.length("text") > 0).select("text", m.text_key().alias("text_key")).join(m.text_scores(docs, model), "text_key").collect()
    want = brute(train, texts)
    assert {r.text for r in got} == set(want)
    for r in got:
        assert r.log_perplexity == pytest.approx(want[r.text], rel=1e-9)


def test_many_words_are_not_broadcast(spark, monkeypatch):
    """Two tables of 850,646 words took 240 MB of the driver's memory."""
    sizes, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda table: sizes.append(table.count()) or broadcast(table))
    texts = spark.range(700).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), F.col("id") * 100 + i))))
    model = m.Model(texts, kneser_ney._discounts)
    assert model.terms.count() == 2 * 70_000 + 700 + 2 and all(n <= 1 << 16 for n in sizes)
    few = m.Model(texts.limit(3), kneser_ney._discounts)
    assert few.terms.count() == 2 * 300 + 3 + 2 and sizes


def test_words_of_other_scripts_differ(spark):
    """Words whose characters fell into the same classes by code point mod 12 are told apart."""
    good, other = "日本", "".join(chr(ord(c) + 12) for c in "日本")
    rows = [(i, " ".join([good] * (5 + i % 7)), "ja") for i in range(200)] + [(900, " ".join([other] * 8), "ja")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in kneser_ney.classify_ids(docs, labels).collect()}
    assert not kept[900] and sum(kept.values()) >= 190
    assert {r.doc_id for r in kneser_ney.keep(docs, labels).collect()} == {i for i, k in kept.items() if k}
