import random

import pytest
import xxhash
from pyspark.sql import functions as F

from neurosheaf.llm import simhash
from neurosheaf.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, id string, component_id string"


def fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """{node: least node reachable} of pairs at most 4 bits apart."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(parent)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    return {f: root(f) for f in nodes}


def test_fingerprints_and_groups_against_brute_force(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]
    near = []
    for t in texts[:25]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    rows = [*texts, *near, *texts[:10], None, "", " \t\n", "É\xa0É X", "Ünïcode WORDS here", "x" * 200_000, "long words " * 40_000]
    docs = spark.createDataFrame([(i, t, "clash", None, "clash") for i, t in enumerate(rows)], SCHEMA)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = [fingerprint(t) for t in rows]
    assert {i: f for i, (f, _) in got.items()} == dict(enumerate(want))
    root = components(set(want))
    least = {}
    for i, f in enumerate(want):
        least.setdefault(root[f], i)
    assert {i: c for i, (_, c) in got.items()} == {i: least[root[f]] for i, f in enumerate(want)}


@pytest.mark.parametrize("band_max", [1, 4, 128])
def test_links_of_crowded_bands_have_the_same_components(spark, band_max):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centre)
    for c in centre[:3]:
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                c ^= 1 << b if rng.random() < 0.7 else 0
            fps.add(c)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), band_max=band_max)
    got = {r.node & (1 << 64) - 1: r.component for r in connected_components(links).collect()}
    want = components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_pivots_discard_pairs_before_they_are_verified(spark):
    """Of pairs that meet in a band, most differ too much in some coordinate; none of these is linked."""
    rng = random.Random(2)
    base = rng.getrandbits(64) >> 37 << 37
    fps = [base | rng.getrandbits(37) for _ in range(120)] + [base | 3, base | 1, base | 0]
    table = simhash.pivot_table(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long"))
    met = table.alias("a").join(table.alias("b"), F.col("a.fp") > F.col("b.fp"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 4
    agree = simhash.coordinates_agree(4)
    n, left, linked, lost = met.agg(F.count("*"), F.count_if(agree), F.count_if(close), F.count_if(close & ~agree)).first()
    assert lost == 0 and 0 < linked <= left < n / 20


@pytest.mark.parametrize("blocks", [7, 9])
def test_every_linked_pair_meets_in_a_band(blocks):
    rng = random.Random(3)
    masks = [m & (1 << 64) - 1 for m in simhash._bands(4, blocks)]
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(bits & m == 0 for m in masks)


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components_of_a_long_path_a_hub_and_nothing(spark, small):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), small).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), small).count() == 0
