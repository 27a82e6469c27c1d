"""SimHash near-duplicates, with pivot distance tables as the pair filter.

Every distinct fingerprint has its Hamming distances to fixed reference fingerprints (pivots).
Two fingerprints within r of each other differ by at most r in each of those coordinates, so a
pair with a larger difference in any coordinate is discarded before it is verified. The table alone
names no pairs without comparing all of them; the pairs come from bands: of seven blocks of bits,
four differing bits leave three blocks equal, so each linked pair meets in one of 35 equi-joins (of nine
blocks and 126 for more than 2**27 fingerprints, so that a band's key has more values than there are fingerprints).

A band with many fingerprints (a large group of near copies) isn't paired up. It is cut by cells of pivot
coordinates, of which a linked pair has the same or neighbouring ones. Fingerprints of cells that are still crowded
go to balls: x and y are within 2r bits if and only if some z is within r of both. Grouping by
z links a group without listing its pairs, so work stays proportional to the number of fingerprints.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, slices
from .components import SMALL, connected_components

BITS = 64
#: Blocks of bits by the number of fingerprints up to which they do.
BLOCKS = [(1 << 27, 7), (1 << 62, 9)]
PIVOTS = 16
#: A band of more fingerprints than this is cut by cells of the first pivots' coordinates, and such a cell is linked by balls.
BAND_MAX, CELL_PIVOTS = 128, 3
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 14


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of ``width`` words of a UTF-8 text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return [digest(joined, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def bit_counts(hashes) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority_bits(hashes: list[int]) -> int:
    """The fingerprint as a signed long; no hashes: 0."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row. A null text or one without words has fingerprint 0."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).cast(pa.large_binary())
            fps = [majority_bits(shingle_hashes(t.as_py(), width, seed)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def pivot_table(fps: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds p0, p1, ...: distances to the pivots, eight a long. Pivots are hashes of 0, 1, ..., the same for any data."""
    pivot = [_signed(xxhash.xxh64_intdigest(str(i).encode(), 7)) for i in range(pivots)]

    def packed(own: list[int]) -> Column:
        out = F.lit(0).cast("long")
        for i, p in enumerate(own):
            distance = F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("long"))).cast("long")
            out = out.bitwiseOR(F.shiftleft(distance, 8 * i))
        return out

    return fps.withColumns({f"p{i // 8}": packed(pivot[i : i + 8]) for i in range(0, pivots, 8)})


def _coordinate(i: int, side: str = "") -> Column:
    return F.shiftright(F.col(f"{side}p{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127).cast("long"))


def coordinates_agree(radius: int, pivots: int = PIVOTS) -> Column:
    """No pivot coordinate of rows a and b differs by more than the radius."""
    agree = F.lit(True)
    for i in range(pivots):
        agree = agree & (F.abs(_coordinate(i, "a.") - _coordinate(i, "b.")) <= radius)
    return agree


def _bands(radius: int, blocks: int) -> list[int]:
    """Bit masks: each keeps all blocks but ``radius`` of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(keep)) for keep in combinations(block, blocks - radius)]


def _in_bands(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    masks = F.array(*(F.lit(m).cast("long") for m in _bands(radius, blocks)))
    banded = fps.select("fp", F.posexplode(masks).alias("band", "mask"))
    return banded.select("fp", "band", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _in_cells(banded: DataFrame, radius: int, around: bool) -> DataFrame:
    """``banded`` (with coordinates) by its cells of the first pivots, 2 * radius wide; or by all cells within the radius of it, 8 at most."""
    out = banded
    for i in range(CELL_PIVOTS):
        at = _coordinate(i)
        cells = F.array_distinct(F.array(*(F.floor((at + d) / (2 * radius)).cast("int") for d in ((-radius, radius) if around else (0,)))))
        out = out.withColumn(f"c{i}", F.explode(cells))
    return out


def _pairs(homes: DataFrame, others: DataFrame, on: list[str], radius: int, pivots: int) -> DataFrame:
    """Pairs (u, v) of rows that meet, u the greater: those that the pivots leave, and of these those within the radius."""
    met = reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on)) & (F.col("a.fp") > F.col("b.fp"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    return homes.alias("a").join(others.alias("b"), met & coordinates_agree(radius, pivots) & close).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _ball_masks(radius: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(BITS), r)]


def _ball_links(hot: DataFrame, radius: int) -> DataFrame:
    """Edges whose components are those of all pairs of ``hot`` (fp) within ``radius`` (even) bits.

    Each z keeps the least and the greatest component in its ball; where they differ, the two are
    joined. Rounds go on until every ball holds one component.
    """
    masks = F.array(*(F.lit(m).cast("long") for m in _ball_masks(radius // 2)))
    hot = cut(hot)
    labels, links = hot.select("fp", F.col("fp").alias("c")), None
    while True:
        balls = labels.select("c", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
        span = balls.groupBy("z").agg(F.min("c").alias("v"), F.max("c").alias("u")).where("u > v")
        new = cut(span.select("u", "v").distinct())
        links = new if links is None else links.union(new)
        if new.isEmpty():
            return links
        moved = connected_components(new, SMALL).withColumnsRenamed({"node": "c", "component": "to"})
        labels = cut(labels.join(moved, "c", "left").select("fp", F.coalesce("to", "c").alias("c")))


def near_links(fps: DataFrame, radius: int = 4, band_max: int = BAND_MAX, pivots: int = PIVOTS) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (fp) with the same components as all pairs within ``radius`` bits.

    ``radius`` is even. A pair in a band of at most ``band_max`` is tested on its pivot coordinates,
    then verified; the fingerprints of larger bands are linked by balls.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    fps = cut(fps)
    n = fps.count()
    banded = _in_bands(fps, radius, next(blocks for most, blocks in BLOCKS if n <= most))
    sizes = cut(banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    some = cut(pivot_table(banded.join(sizes, ["band", "key"]), pivots))
    small, large = some.where(F.col("n") <= band_max), some.where(F.col("n") > band_max)
    links = _pairs(small, small, ["band", "key"], radius, pivots)
    if large.isEmpty():
        return links
    where = ["band", "key", *(f"c{i}" for i in range(CELL_PIVOTS))]
    homes, around = cut(_in_cells(large, radius, False)), _in_cells(large, radius, True)
    cells = cut(homes.groupBy(where).agg(F.count("*").alias("m")))
    links = links.union(_pairs(homes.join(cells.where(F.col("m") <= band_max), where, "left_semi"), around, where, radius, pivots))
    # Pairs of a crowded cell: both its own fingerprints and those around it.
    crowded = cut(around.join(cells.where(F.col("m") > band_max), where, "left_semi").select("fp").distinct())
    return links if crowded.isEmpty() else links.union(_ball_links(crowded, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the least id reachable over links of at most ``radius`` differing bits, the
    row's own included. Null or wordless texts share fingerprint 0 and are linked like any other;
    repeated rows are returned each; a null id takes part, and a group of null ids only has a null
    component_id. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width, seed))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(near_links(classes.select("fp"), radius), SMALL).withColumnsRenamed({"node": "fp", "component": "c"})
    placed = cut(classes.join(found, "fp", "left").select("fp", "least", F.coalesce("c", "fp").alias("c")))
    firsts = placed.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(dealt(firsts), "c").select("fp", "component_id")
    return marked.join(cut(by_fp), "fp").select("id", "fp", "component_id")

