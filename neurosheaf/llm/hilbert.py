"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to a few bits each, the cell's index on the curve orders the rows,
and the order is cut into runs of equal length. Rows near each other in all dimensions share a
shard, so a filter on any of them touches few files.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, shared_dir

#: Cells at most: their curve indices are a literal array, and their counts one ordered window.
MAX_CELL_BITS = 12
#: Rows of a cell are split by a hash of the id into this many slices, so that no cell is one group.
SLICES = 1024


@cache
def hilbert_order(dims: int, bits: int) -> list[int]:
    """The curve index of each cell; a cell is its coordinates put together, the first one highest.

    The curve of n dimensions visits 2**n blocks in Gray-code order. Inside each, it is the same curve
    one level down, entered at a corner ``entry`` and turned by ``turn`` axes (Hamilton, 2006).
    """
    mask = (1 << dims) - 1

    def rotated(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask if by else x

    def visit(w: int) -> tuple[int, int]:
        if w == 0:
            return 0, 0
        even = 2 * ((w - 1) // 2)
        odd = w if w % 2 else w - 1
        return even ^ (even >> 1), ((~odd & (odd + 1)).bit_length() - 1) % dims

    order = [0] * (1 << (dims * bits))

    def walk(level: int, corner: list[int], entry: int, turn: int, start: int) -> None:
        if level < 0:
            order[reduce(lambda cell, c: cell << bits | c, corner, 0)] = start
            return
        for w in range(1 << dims):
            block = rotated(w ^ (w >> 1), turn + 1) ^ entry
            e, d = visit(w)
            inner = [c | ((block >> k) & 1) << level for k, c in enumerate(corner)]
            walk(level - 1, inner, entry ^ rotated(e, turn + 1), (turn + d + 1) % dims, start + (w << (dims * level)))

    walk(bits - 1, [0] * dims, 0, 0, 0)
    return order


def by_hash(value: Column, bits: int) -> Column:
    """A categorical dimension: equal values share a coordinate. Null: 0."""
    return F.coalesce(F.conv(F.substring(F.md5(value.cast("string")), 1, 7), 16, 10).cast("int") % (1 << bits), F.lit(0)).cast("int")


def by_log2(value: Column, bits: int) -> Column:
    """A count or size: its binary order of magnitude. Null, zero and below: 0."""
    return F.when(value > 0, F.least(F.length(F.bin(value.cast("long"))), F.lit((1 << bits) - 1))).otherwise(0).cast("int")


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The index on the curve of int coordinates of ``bits`` bits each."""
    dims = len(coordinates)
    if dims < 2 or dims * bits > MAX_CELL_BITS:
        raise ValueError(f"two dimensions at least, {MAX_CELL_BITS} bits at most")
    cell = reduce(lambda a, c: F.shiftleft(a, bits).bitwiseOR(c), coordinates)
    return F.get(F.lit(hilbert_order(dims, bits)), cell)


def hilbert_shards(df: DataFrame, coordinates: list[Column], bits: int, shards: int, tie: Column, further: tuple[Column, ...] = ()) -> DataFrame:
    """Adds curve (int), shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Shards are runs of the order (curve, hash slice of tie, tie), and their counts differ by one at
    most. Rows of one tie are ordered by ``further``, so that a task run again gives them the same slots. Null coordinates aren't allowed (the quantisers give
    none); a null tie is one more value. Fewer rows than shards: some shards stay empty. The columns
    curve, slice, shard and slot of ``df`` are replaced.

    Two passes: counts of (cell, slice), bounded by 2**12 times SLICES rows and summed up by cell,
    then a row number inside each (cell, slice). No group holds more than a slice of a cell.
    """
    slices = F.coalesce(F.conv(F.substring(F.md5(tie.cast("string")), 1, 7), 16, 10).cast("int") % SLICES, F.lit(0)).cast("int")
    placed = df.withColumns({"curve": hilbert_index(coordinates, bits), "slice": slices})
    counts = placed.groupBy("curve", "slice").agg(F.count("*").alias("n"))
    in_cell = W.partitionBy("curve").orderBy("slice")
    counts = counts.select("curve", "slice", (F.sum("n").over(in_cell) - F.col("n")).alias("before"))
    cells = placed.groupBy("curve").agg(F.count("*").alias("n"))
    cells = cells.select(
        F.col("curve").alias("cell"),
        (F.sum("n").over(W.orderBy("curve")) - F.col("n")).alias("start"),
        F.sum("n").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    at_curve, at_slice, start, total = (fresh(placed.columns, c) for c in ("curve", "slice", "start", "total"))
    offsets = counts.join(F.broadcast(cells), F.col("curve") == F.col("cell")).select(
        F.col("curve").alias(at_curve), F.col("slice").alias(at_slice), (F.col("start") + F.col("before")).alias(start), F.col("total").alias(total)
    )
    ranked = placed.withColumn("slot", F.row_number().over(W.partitionBy("curve", "slice").orderBy(tie, *further)) - 1)
    ranked = ranked.join(offsets, (F.col("curve") == F.col(at_curve)) & (F.col("slice") == F.col(at_slice)))
    rank = F.col(start) + F.col("slot")
    shard = F.expr(f"({shards} * ({start} + slot)) div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (rank - first).cast("long"))
        .drop(at_curve, at_slice, start, total, "slice")
    )


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Writes Parquet under ``path``/shard=k, rows in curve order, and returns what each shard spans for pruning.

    Hot or large shards are written by several tasks: rows are dealt out by ranges of (shard, slot).
    """
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
    plain = [c for c, kind in sharded.dtypes if kind in {"string", "bigint", "int", "double", "date", "timestamp"} and c not in {"shard", "slot"}]
    spans = [f(c).alias(f"{n}_{c}") for c in plain for n, f in (("min", F.min), ("max", F.max))]
    return sharded.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"), *spans)


def prune(manifest: DataFrame, column: str, low, high) -> DataFrame:
    """The shards whose span of ``column`` meets [low, high]."""
    return manifest.where((F.col(f"max_{column}") >= low) & (F.col(f"min_{column}") <= high)).select("shard")
