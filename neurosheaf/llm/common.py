"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper-case and lower-case ASCII letters, for ``translate``.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A session in local mode without one gets a temporary folder."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            known = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder, with their lineage cut. For what is small or lasts as long as the result; see Scratch for more."""
    shared_dir(df.sparkSession)
    with _freed(df.sparkSession):
        return df.checkpoint()


#: Frees a statement's shuffle files when it has ended; what it made then stands in the shared folder.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession):
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def gathered(df: DataFrame) -> pa.Table:
    """The rows of a table of bounded size, on the driver."""
    with _freed(df.sparkSession):
        return df.toArrow()


class Scratch:
    """Tables that an operator makes on its way, as Parquet in the shared folder: a lost executor takes none with it. Their
    shuffle files go as soon as a table stands, and a table goes with drop(), when what was made from it stands."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        with _freed(self.spark):
            df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = kept, path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths[id(t)][1])

    def clear(self) -> None:
        """Removes all of them."""
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store Spark wrote it to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


#: Ids that are broadcast at most (about 40 MB); of more a bitmap is.
BROADCAST_IDS = 1_000_000
#: Longs of that bitmap: 2^26 bits, in 2^20 rows of about 40 MB.
BITMAP = 1 << 20


def by_ids(df: DataFrame, ids: DataFrame, on: dict[str, Column], how: str = "left_semi") -> DataFrame:
    """A semi, anti or inner join of rows with a table of ids: ``on`` has for each of its key columns what it is equal to in the rows, nulls included.

    The table's size is looked at first. A short one goes to the rows, which then stay where they are. Of a longer one a bitmap of its
    hashes goes to them: rows whose bit isn't set have no partner and stay where they are too. Only the others are shuffled: those that have one, and,
    of n ids, a share of n / 2^26 of the rest. For an inner join other columns of ``ids`` come along; names may clash, as they are told apart inside."""
    fresh_name = {c: fresh([*df.columns, *ids.columns], f"key{i}") for i, c in enumerate(on)}
    kinds = dict(df.select(*(key.alias(c) for c, key in on.items())).dtypes)
    ids = cut(ids.select(*(F.col(c).cast(kinds[c]).alias(n) for c, n in fresh_name.items()), *(c for c in ids.columns if c not in on)))
    equal = reduce(and_, (key.eqNullSafe(F.col(fresh_name[c])) for c, key in on.items()))
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), equal, how).drop(*fresh_name.values())
    slot, bit, word, bits = (fresh(df.columns, c) for c in ("slot", "bit", "word", "bits"))
    place = F.pmod(F.xxhash64(*(F.col(n) for n in fresh_name.values())), F.lit(64 * BITMAP))
    marks = ids.select(F.floor(place / 64).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("mark"))
    marks = cut(marks.groupBy(word).agg(F.bit_or("mark").alias(bits)))
    own = F.pmod(F.xxhash64(*on.values()), F.lit(64 * BITMAP))
    placed = df.withColumns({slot: F.floor(own / 64), bit: (own % 64).cast("int")}).join(F.broadcast(marks), F.col(slot) == F.col(word), "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col(bits), F.col(bit)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    joined = placed.where(maybe).drop(slot, bit, word, bits).join(ids, equal, how).drop(*fresh_name.values())
    return placed.where(~maybe).drop(slot, bit, word, bits).unionByName(joined) if how == "left_anti" else joined


#: Steps a doubling in which counts are compared when the most frequent rows are looked for.
FINE = 16


def most_frequent(table: DataFrame, count: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the highest counts, ``limit`` at most, and all others; None if there are no others.

    Counts are taken in steps of a 16th of a doubling, so that a bounded number of rows reaches the driver; if even the
    highest step holds more than ``limit`` rows, all are others."""
    step = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * FINE)
    steps = sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r.step)
    least, room = None, limit
    for r in steps:
        room -= r.m
        if room < 0:
            break
        least = r.step
    if room >= 0:
        return table, None
    return (table.where(step >= least), table.where(step < least)) if least is not None else (table.limit(0), table)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly. A join on what was grouped before then has an exchange of its own on both
    sides, so that adaptive execution can split the partition of a hot key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    return next(x for i in range(len(taken) + 1) if (x := f"_{name}{i}") not in taken)


_RESIDENT: dict[str, object] = {}


def resident(key: str, build):
    """What ``build`` makes, kept in this worker process; asking for another key drops it, so that a worker that serves
    several operators keeps one's large object only."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def slices(batches, rows: int = 256):
    """Arrow batches in parts of a few rows, so that what Python makes of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def widened(df: DataFrame, columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])
