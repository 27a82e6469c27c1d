import random
import re

import numpy as np
import pytest

import corpus_pipeline
from neurosheaf.llm import similar as j


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_ids(rows):
    """{id: least id of its group} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def corpus(rng):
    rows = []
    for k in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 100, 300, 1000]))]
        rows.append(" ".join(w))
        for share in (0.02, 0.05, 0.08, 0.12, 0.3):  # a run of words replaced
            n = max(1, round(share * len(w)))
            at = rng.randrange(len(w) - n)
            rows.append(" ".join(w[:at] + [f"n{rng.randrange(3000)}" for _ in range(n)] + w[at + n :]))
    return list(enumerate([*rows, None, "", "one two", "One  two", *rows[:5]]))


@pytest.mark.parametrize("rounds", [j.ROUNDS, []])
def test_groups_against_all_pairs(spark, monkeypatch, rounds):
    """Every link is one of all pairs, and hardly one of those is missed, though pairs are as far apart as 0.8."""
    monkeypatch.setattr(j, "ROUNDS", rounds)
    rows = corpus(random.Random(0))
    got = {r.id: r.component_id for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = least_ids(rows)
    assert set(got) == set(want)
    assert all(want[i] == want[c] for i, c in got.items())
    together = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in together) >= 0.98 * len(together) > 50


def test_large_groups_are_found_without_listing_their_pairs(spark, monkeypatch):
    """300 copies of one text with two words changed each: every bucket is crowded."""
    rng, pairs, judge = random.Random(2), [], j._Search.judge

    def counted(self, found):
        pairs.append(found.count())
        judge(self, found)

    monkeypatch.setattr(j._Search, "judge", counted)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        own = list(words)
        for _ in range(2):
            own[rng.randrange(400)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(200))) for i in range(50)]
    got = {r.id: r.component_id for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 300 else i for i, _ in rows}
    assert sum(pairs) < 4 * 300


def test_crowds_that_are_too_far_apart_are_not_paired(spark, monkeypatch):
    """400 texts of one origin, each with a quarter of its words changed, and a few that are near copies of one another."""
    rng, pairs, judge = random.Random(5), [], j._Search.judge

    def counted(self, found):
        pairs.append(found.count())
        judge(self, found)

    monkeypatch.setattr(j._Search, "judge", counted)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own, at = list(words), rng.randrange(225)
        own[at : at + 75] = [f"n{rng.randrange(10**6)}" for _ in range(75)]
        rows.append((i, " ".join(own)))
    for i in range(10):
        own = rows[i][1].split()
        own[rng.randrange(300)] = "changed"
        rows.append((1000 + i, " ".join(own)))
    got = {r.id: r.component_id for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 if i >= 1000 else i for i, _ in rows}
    assert sum(pairs) < 410 * 409 / 2 / 5


def test_buckets_by_plain_distances():
    rng = np.random.default_rng(0)
    counters = rng.integers(-50, 50, (5, 64))
    got, refs = j.buckets(counters, 2, 3), j.references(6)
    for row, own in zip(counters, got, strict=True):
        for t in range(3):
            code = 0
            for d in range(2):
                columns = refs[:, 64 * (2 * t + d) :][:, :64]
                # Counters' weights of the bits that differ, for the 64 references and their opposites.
                far = [[np.abs(row)[np.sign(row) * side * c < 0].sum() for side in (1, -1)] for c in columns.T]
                code |= int(np.argmin(np.array(far).ravel())) << 7 * d
            assert own[t] == t << 14 | code


def test_deduplicate(spark):
    text, other = " ".join(f"word{i}" for i in range(100)), " ".join(f"else{i}" for i in range(80))
    rows = [(5, text), (3, text), (9, other), (9, other), (9, "quite another text"), (None, text), (None, "alone"), (None, "alone"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, k, "c", "d") for k, r in enumerate(rows)], "doc_id long, text string, row int, text_hash string, _id0 string")
    got = [(r.doc_id, r.text) for r in j.deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, text), (9, other), (9, "quite another text"), (None, "alone"), (7, None)], key=str)
    assert j.deduplicate(docs).columns == docs.columns
    assert j.deduplicate(docs.limit(0)).count() == 0
    long = "word " * 300_000
    assert [r.doc_id for r in j.deduplicate(spark.createDataFrame([(2, long), (1, long + "word")], "doc_id long, text string")).collect()] == [1]


def test_stage_drops_near_copies_from_jaccard_0_8(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, "").collect()}
    want = set(least_ids(rows).values())
    assert got >= want and len(got - want) <= 0.02 * len(want)
