"""Near copies of at least a Jaccard similarity of word shingles: SimHash names pairs, pivots discard, whole sets verify.

Texts with equal sets of shingles are one class. A class has SimHash counters (for each bit, the hashes that have it less
those that don't) and a fingerprint, their signs. Counters are held against many fixed reference fingerprints: sets of 64 that
differ pairwise in half of their bits, and their opposites. A class goes to one bucket a table, that of its nearest reference in
each of a few sets, by the Hamming distance weighted with the counters. Classes that share a bucket are candidates; of these,
pairs too unlike in size, those that a pivot coordinate tells apart by more than RADIUS, and those whose fingerprints differ in
more bits are discarded, and the Jaccard similarity of the two whole sets decides on the others.

Two bits of SimHashes differ with the probability angle / pi, which is 0.15 at a similarity of 0.8: tables and RADIUS are
chosen for that. By simulation (30 to 300 words) a pair shares a bucket with probability 0.95 at 0.8, 0.99 at 0.85 and 0.999 at
0.9, and RADIUS discards one of 1,000 at 0.8. At such a radius the pivots discard little beyond what the distance itself does.

A bucket isn't paired up. First a class is held against the most copied of the leaders of its buckets, then, in a few rounds, against
the nearest of several leaders in some tables, always one that isn't in its group so far; most of a large group is one group
then. What is then in no bucket's largest group is held against all of its buckets, so no pair that could join two groups is left out;
pairs within a group are never listed. In crowded buckets (many texts of one origin, but too far apart) the shingles that no
other class there has are counted first: they can't be shared, so they bound the similarity of a class with any other. And each
class has a bitmap of its shingles' hashes: a bit that only one of two classes has is a shingle that the other lacks. Most classes
and pairs go by these bounds, which discard nothing that reaches the similarity.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_ids, cut, dealt, fresh, slices
from .components import SMALL, connected_components
from .simhash import BITS, bit_counts, coordinates_agree, pivot_table, shingle_hashes

WIDTH, LEAST = 5, 0.8
#: Bits that may differ: a pair of similarity 0.8 has more with probability 0.001.
RADIUS = 20
#: Sets of references a table, 7 bits of selectivity each, the classes up to which they do (8 a bucket), and tables that give the same recall.
DEPTHS = [(3, 1 << 24, 48), (4, 1 << 31, 160)]
#: Rounds against leaders: how many a bucket has (those with most copies, of as many parts of it), and of how many tables one takes part.
ROUNDS = [(1, 1), (8, 8)]
#: Classes of a bucket from which their own shingles are counted.
CROWDED = 24
#: Room for rounding where whole numbers are held against shares of others.
CLOSE = 1e-6
#: Bits of a set's key. Sets that share one are told apart by a second hash of 64 bits, whatever its length.
KEY_BITS = 64
#: Longs of the bitmap of such a class's shingles.
WORDS = 16


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width, 42), np.uint64))


@cache
def references(sets: int) -> np.ndarray:
    """Sets of 64 sign vectors each, as columns; vectors of a set are orthogonal."""
    at = np.arange(BITS)
    signs = 1 - 2 * (np.bitwise_count(at[:, None] & at[None, :]) % 2).astype(float)
    turned = []
    for s in range(sets):
        flips = xxhash.xxh64_intdigest(b"%d" % s, 11)
        turned.append(signs * np.array([1 - 2 * (flips >> i & 1) for i in range(BITS)])[:, None])
    return np.concatenate(turned, axis=1)


def buckets(counters: np.ndarray, depth: int, tables: int) -> np.ndarray:
    """A row of bucket numbers, one a table, for each row of counters. Sums are of whole numbers, so they are exact."""
    y = (counters.astype(float) @ references(depth * tables)).reshape(len(counters), depth * tables, BITS)
    nearest = np.abs(y).argmax(axis=2)
    opposite = np.take_along_axis(y, nearest[:, :, None], axis=2)[:, :, 0] < 0
    code = (2 * nearest + opposite).reshape(len(counters), tables, depth)
    return (code << 7 * np.arange(depth)).sum(axis=2) | np.arange(tables) << 7 * depth


def _signatures(slim: DataFrame, width: int) -> DataFrame:
    """(id, text_hash, set_key, set_check, fp, size, counters) of ``slim`` (id, text_hash, text)."""
    bits = (1 << KEY_BITS) - 1

    def run(batches):
        for b in slices(batches):
            keys, checks, fps, sizes, counters = [], [], [], [], []
            for t in b.column(2).cast(pa.large_binary()):
                own = shingle_set(t.as_py(), width)
                signed = 2 * bit_counts(own) - len(own)
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), 5) & bits)
                checks.append(xxhash.xxh64_intdigest(own.tobytes(), 6))
                fps.append(int(np.packbits(signed > 0, bitorder="little").view("<i8")[0]))
                sizes.append(len(own))
                counters.append(signed.astype("<i4").tobytes())
            keys, checks = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, checks))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys, checks, pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(counters, pa.binary())], names=["id", "text_hash", "set_key", "set_check", "fp", "size", "counters"])

    return slim.mapInArrow(run, "id long, text_hash long, set_key long, set_check long, fp long, size int, counters binary")


def _classes(marked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``marked`` and its classes, a row a set of shingles. A key that two different sets share is given up: their rows take
    the second hash for a key, so texts are copies only if all 128 bits agree."""
    row = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash")
    named = [F.min(row).alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("fp", "size", "counters"))]
    classes = scratch.keep(marked.groupBy("set_key").agg(*named, F.min("set_check").alias("low"), F.max("set_check").alias("high")))
    shared = cut(classes.where("low <> high").select("set_key"))
    if not shared.isEmpty():
        apart = marked.join(shared.withColumn("shared", F.lit(True)), "set_key", "left").withColumn("set_key", F.when(F.col("shared"), F.col("set_check")).otherwise(F.col("set_key"))).drop("shared")
        marked, before = scratch.keep(apart.select(marked.columns)), (marked, classes)
        classes = scratch.keep(marked.groupBy("set_key").agg(*named))
        scratch.drop(*before)
    return marked, classes.select("set_key", "first", "copies", "fp", "size", "counters")


def _placed(classes: DataFrame, depth: int, tables: int) -> DataFrame:
    """(bucket, set_key) of ``classes`` (set_key, counters)."""

    def run(batches):
        for b in slices(batches, 128):
            if b.num_rows:
                counters = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, BITS)
                yield pa.RecordBatch.from_arrays([pa.array(buckets(counters, depth, tables).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), tables))], names=["bucket", "set_key"])

    return classes.mapInArrow(run, "bucket long, set_key long")


def _candidate(least: float, radius: int) -> Column:
    """Of rows a and b of a bucket: what is left when sizes, pivot coordinates and distances have discarded."""
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    return (small + CLOSE >= F.lit(least) * large) & coordinates_agree(radius, 16) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs`` (u, v) whose texts have at least the similarity ``least``; texts: (set_key, text)."""

    def run(batches):
        lead, own = None, None
        for b in slices(batches, 64):
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for key, x, y in zip(u, b.column(2).cast(pa.large_binary()), b.column(3).cast(pa.large_binary()), strict=True):
                if key != lead:
                    lead, own = key, shingle_set(x.as_py(), width)
                other = shingle_set(y.as_py(), width)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(shared + CLOSE >= least * (len(own) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(u, keep, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(v, keep, strict=True) if k], pa.int64())], names=["u", "v"])

    seconds = pairs.join(texts.select(F.col("set_key").alias("v"), F.col("text").alias("y")), "v")
    leads = texts.join(pairs.select(F.col("u").alias("set_key")).distinct(), "set_key", "left_semi")
    both = seconds.join(dealt(leads.select(F.col("set_key").alias("u"), F.col("text").alias("x"))), "u")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


class _Search:
    """Links between classes, round by round."""

    def __init__(self, slim: DataFrame, classes: DataFrame, members: DataFrame, scratch: Scratch, width: int, least: float, radius: int, depth: int):
        self.slim, self.classes, self.members, self.scratch = slim, classes, members, scratch
        self.table = F.shiftright("bucket", 7 * depth)
        self.width, self.least, self.radius = width, least, radius
        self.links = self.tried = None

    def grouped(self) -> DataFrame:
        """``members`` with their group c so far."""
        if self.links is None:
            return self.members.withColumn("c", F.col("set_key"))
        groups = connected_components(self.links, SMALL).withColumnsRenamed({"node": "set_key", "component": "c"})
        return self.members.join(groups, "set_key", "left").withColumn("c", F.coalesce("c", "set_key"))

    def judge(self, pairs: DataFrame) -> None:
        """Verifies pairs (u, v) that weren't yet."""
        pairs = pairs if self.tried is None else pairs.join(self.tried, ["u", "v"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            return
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("set_key")).distinct()
        texts = self.rows_of(wanted).groupBy("set_key").agg(F.first("text").alias("text"))
        found = cut(_verified(pairs, texts, self.width, self.least))
        self.links = found if self.links is None else self.links.union(found)
        self.tried = pairs if self.tried is None else self.tried.union(pairs)

    def against_leaders(self, turn: int) -> None:
        many, apart = ROUNDS[turn]
        placed = self.scratch.keep(self.grouped().where(self.table % apart == turn))
        part = F.pmod(F.xxhash64("set_key", F.lit(turn)), F.lit(many))
        first = F.min(F.struct((-F.col("copies")).alias("most"), "set_key", "c", "copies", "fp", "size", "p0", "p1")).alias("x")
        # A bucket's leaders, one a part of it, where it has several groups. Of two classes alone the least and greatest values are
        # theirs, so that those too unlike in size or fingerprint, as chance brings together, go here.
        ends = [(f, n, c) for c in ("c", "size", "fp") for f, n in ((F.min, "low"), (F.max, "high"))]
        parts = placed.groupBy("bucket", part.alias("part")).agg(first, F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for f, n, c in ends))
        found = parts.groupBy("bucket").agg(F.collect_list("x").alias("x"), F.sum("n").alias("n"), *(f(f"{n}_{c}").alias(f"{n}_{c}") for f, n, c in ends))
        unlike = (F.col("low_size") + CLOSE < F.lit(self.least) * F.col("high_size")) | (F.bit_count(F.col("low_fp").bitwiseXOR(F.col("high_fp"))) > self.radius)
        found = found.where("low_c <> high_c").where((F.col("n") > 2) | ~unlike)
        leaders = dealt(found.select("bucket", F.explode("x").alias("x")).select("bucket", "x.*"))
        near = placed.alias("b").join(leaders.alias("a"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.c") != F.col("b.c")) & _candidate(self.least, self.radius))
        distance = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
        copied = -F.col("a.copies") if many == 1 else F.lit(0).cast("long")
        nearest = near.groupBy(F.col("b.set_key").alias("v")).agg(F.min(F.struct(copied.alias("copied"), distance.alias("d"), F.col("a.set_key").alias("u"))).alias("x"))
        self.judge(nearest.select("x.u", "v"))
        self.scratch.drop(placed)

    def rest(self) -> None:
        placed = self.scratch.keep(self.grouped())
        counts = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
        largest = counts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("x"), F.count("*").alias("groups"), F.sum("n").alias("n")).where("groups > 1")
        largest = largest.select("bucket", F.col("x.c").alias("largest"), (F.col("n") > CROWDED).alias("crowded"))
        left = self.scratch.keep(placed.join(dealt(largest), "bucket").withColumn("outside", F.col("c") != F.col("largest")).drop("largest"))
        own = self.own_shingles(left.where("crowded").select("set_key").distinct())
        bounded = self.scratch.keep(left.join(own, "set_key", "left").join(self.bitmaps(own), "set_key", "left").where(~F.col("crowded") | (F.col("size") - F.col("own") + CLOSE >= F.lit(self.least) * F.col("size"))))
        # What two classes can share at most; both have to be among those that were counted.
        lacking = lambda x, y: reduce(add, (F.bit_count(F.col(f"{x}.w{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.w{i}")))) for i in range(WORDS)))
        shared = F.least(*(F.col(f"{x}.size") - F.greatest(F.col(f"{x}.own"), lacking(x, y).cast("long")) for x, y in ("ab", "ba")))
        bound = F.col("a.own").isNull() | F.col("b.own").isNull() | (shared * (1 + self.least) + CLOSE >= F.lit(self.least) * (F.col("a.size") + F.col("b.size")))
        pairs = bounded.where("outside").alias("a").join(
            bounded.alias("b"),
            # Two that are outside of the largest group meet twice; one meeting counts.
            (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.c") != F.col("b.c")) & (~F.col("b.outside") | (F.col("a.set_key") < F.col("b.set_key"))) & bound & _candidate(self.least, self.radius),
        )
        self.judge(pairs.select(F.least("a.set_key", "b.set_key").alias("u"), F.greatest("a.set_key", "b.set_key").alias("v")).distinct())
        self.scratch.drop(placed, left, bounded)

    def rows_of(self, wanted: DataFrame) -> DataFrame:
        """(set_key, text) of the wanted classes' first rows, which stay where they are if they are few."""
        firsts = self.classes.join(wanted, "set_key").select("set_key", F.col("first.id").alias("own_id"), F.col("first.text_hash").alias("own_hash"))
        return by_ids(self.slim, firsts, {"own_id": F.col("id"), "own_hash": F.col("text_hash")}, "inner").select("set_key", "text")

    def bitmaps(self, classes: DataFrame) -> DataFrame:
        """(set_key, w0, w1, ...) of ``classes``."""
        width = self.width

        def run(batches):
            for b in slices(batches, 256):
                bits = np.zeros((b.num_rows, 64 * WORDS), np.uint8)
                for row, t in zip(bits, b.column(1).cast(pa.large_binary()), strict=True):
                    row[shingle_set(t.as_py(), width) % np.uint64(64 * WORDS)] = 1
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))], names=["set_key", *(f"w{i}" for i in range(WORDS))])

        columns = [f"w{i}" for i in range(WORDS)]
        found = self.rows_of(classes.select("set_key")).mapInArrow(run, "set_key long, " + ", ".join(f"{c} long" for c in columns))
        # Rows that repeat an id and text have equal bitmaps.
        return found.groupBy("set_key").agg(*(F.max(c).alias(c) for c in columns))

    def own_shingles(self, classes: DataFrame) -> DataFrame:
        """(set_key, own): how many shingles of each of ``classes`` no other one of them has."""
        classes, width = cut(classes), self.width

        def run(batches):
            for b in slices(batches, 64):
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in b.column(1).cast(pa.large_binary())]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), list(map(len, sets)))), pa.array(np.concatenate(sets))], names=["set_key", "shingle"])

        held = self.rows_of(classes).mapInArrow(run, "set_key long, shingle long")
        single = held.groupBy("shingle").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("last")).where("set_key = last")
        return classes.join(single.groupBy("set_key").agg(F.count("*").alias("own")), "set_key", "left").select("set_key", F.coalesce("own", F.lit(0)).alias("own"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, component_id, is_first) for every row: groups over pairs of at least ``least`` Jaccard similarity.

    The first of a group is its row of the least id (rows without one come last) and, of rows that share an id, the
    one whose text has the least hash; component_id is the first one's id. Rows that repeat both id and text are all first if
    one is. Words are separated by ASCII white space and A-Z lower-cased; fewer than ``width`` are one shingle. Null texts and
    texts without words are copies of one another. Sets are equal if 128 bits of hashes are. No rows: no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "near-copies")
    marked = scratch.keep(_signatures(slim, width))
    marked, classes = _classes(marked, scratch)
    n = classes.count()
    depth, _, tables = next((d for d in DEPTHS if n <= d[1]), DEPTHS[-1])
    placed = scratch.keep(_placed(classes.where("size > 0").select("set_key", "counters"), depth, tables))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    coordinates = pivot_table(classes.select("set_key", "fp", "size", "copies"))
    members = scratch.keep(placed.join(dealt(shared), "bucket").join(coordinates, "set_key").select("bucket", "set_key", "fp", "size", "copies", "p0", "p1"))
    scratch.drop(placed)
    search = _Search(slim, classes, members, scratch, width, least, radius, depth)
    for turn in range(len(ROUNDS)):
        search.against_leaders(turn)
    search.rest()
    own = classes.select("set_key", "first")
    if search.links is None:
        firsts = own
    else:
        groups = connected_components(search.links, SMALL).withColumnsRenamed({"node": "set_key", "component": "c"})
        grouped = own.join(groups, "set_key", "left").withColumn("c", F.coalesce("c", "set_key"))
        firsts = grouped.select("set_key", "c").join(dealt(grouped.groupBy("c").agg(F.min("first").alias("first"))), "c").select("set_key", "first")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    found = marked.select("id", "text_hash", "set_key").join(dealt(firsts), "set_key").select("id", "text_hash", F.col("first.id").alias("component_id"), is_first.alias("is_first"))
    out = cut(found)
    scratch.clear()
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, the first, of each group of near copies; all columns pass through, whatever their names.

    Rows that share an id but not the text are different documents. Of rows that repeat both, the one
    of the least hash over all columns stays. Texts that stay aren't moved, but for a few (see common.by_ids); rows that
    repeat an id and text are shuffled.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    own = {"id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(text_col)}
    left = by_ids(docs, found.where("not is_first").select("id", "text_hash").distinct(), own, "left_anti")
    twice = cut(found.where("is_first").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "text_hash"))
    if twice.isEmpty():
        return left
    repeated = by_ids(left, twice, own)
    one = repeated.groupBy(F.col(id_col), F.xxhash64(text_col)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return by_ids(left, twice, own, "left_anti").unionByName(one.select("row.*"))
