import random
import re

from neurosheaf.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id string, containment string, doc string"


def grams(text, width=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, items, least=0.8):
    out = {}
    for i, t in docs:
        own = grams(t)
        for j, it in items:
            g = grams(it)
            if g and len(g & own) / len(g) >= least:
                out[i, j] = max(out.get((i, j), 0), len(g & own) / len(g))
    return out


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["la", "mo", "ti", "su"]) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(0)
    items = [(j, prose(rng, n)) for j, n in enumerate([5, 6, 9, 16, 20, 21, 33, 40, 64, 70, 130, 300, 700])] + [(50, None), (51, ""), (52, "two words"), (53, "!!! ???")]
    docs = [(i, prose(rng, rng.randint(1, 900))) for i in range(60)]
    for i, (j, t) in enumerate(items[:13]):
        w = t.split()
        docs += [(100 + i, f"{prose(rng, 300)} {t.upper()}! {prose(rng, 2000)}"), (200 + i, t), (300 + i, " ".join(w[: len(w) // 2])), (500 + i, f"{' '.join(w[: len(w) * 9 // 10])} {prose(rng, 50)}")]
        half = len(w) // 2
        docs.append((400 + i, f"{' '.join(w[: half + 4])} {prose(rng, 5000)} {' '.join(w[half:])}"))  # in two places
    docs += [(900, None), (901, ""), (902, "so two words"), (903, "two words"), (904, "x " * 100_000 + items[5][1]), (904, items[5][1])]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in d.contained(df, bench).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.containment)
    assert got == brute(docs, items)
    left = sorted(r.doc_id for r in d.decontaminate(df, bench).collect())
    hit = {i for i, _ in got}
    assert left == sorted(i for i, _ in docs if i not in hit)


def test_blocks_of_items_and_shared_ids(spark, monkeypatch):
    rng = random.Random(1)
    items = [(j // 2, prose(rng, 30)) for j in range(40)]
    docs = [(j, f"{prose(rng, 40)} {t}") for j, (_, t) in enumerate(items)]
    monkeypatch.setattr(d, "BLOCK_SHINGLES", 200)
    got = {(r.doc_id, r.item_id) for r in d.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == set(brute(docs, items))


def test_nulls_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "z"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.contained(docs, bench).collect()] == [(None, 1)]
    assert d.contained(docs.limit(0), bench).count() == 0
    assert d.contained(docs, bench.limit(0)).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).count() == 3


def test_size_classes():
    assert [d.size_class(n) for n in (1, 16, 17, 32, 33, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]


def test_short_items_in_long_documents_are_all_found(spark):
    rng = random.Random(2)
    items = [(j, " ".join(f"q{rng.randrange(10**6)}" for _ in range(5 + j % 4))) for j in range(400)]
    docs = [(j, f"{prose(rng, rng.randint(20, 60))} {t} {prose(rng, rng.randint(20, 60))}") for j, t in items]
    got = {(r.doc_id, r.item_id) for r in d.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(j, j) for j, _ in items}


def test_rows_without_an_id_are_judged_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "clean"), (None, None), (2, "one two three four five six"), (3, "z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in d.decontaminate(docs, bench).collect()) == [(0, ""), (0, "clean"), (3, "z")]
