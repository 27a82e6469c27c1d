"""Signals as relations: samples, channels, blocks; selection, cropping, appending.

A signal is rows (recording, channel, sample, value); sample counts from 0 within a channel. Blocks
hold runs of a channel's samples as arrays. Everything is keyed by recording and channel, so any
number of recordings are processed at once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["recording", "channel"]


def in_order(*more: str) -> W:
    """The window over a channel's samples in order."""
    return W.partitionBy(*KEY, *more).orderBy("sample")


def time_to_index(time: Column, sfreq: float, n: Column | None = None) -> Column:
    """The sample nearest to a time in seconds (half to even), held within [0, n]."""
    at = F.rint(time * F.lit(float(sfreq))).cast("long")
    return at if n is None else F.least(F.greatest(at, F.lit(0).cast("long")), n)


class Wide(NamedTuple):
    """Samples as one column a channel: rows (recording, sample, and the channels' values), or an epoch's (recording, epoch, condition, time)."""

    rows: DataFrame
    channels: list[str]


class Whole(NamedTuple):
    """Samples as blockwise.in_blocks() gives them, a row a channel; all of them within a block's size if ``short``."""

    blocks: DataFrame
    short: bool


def remember(samples: DataFrame, made_of: Wide | Whole) -> DataFrame:
    """``samples`` themselves, which now tell what they were made of; whatever is made from them doesn't know."""
    samples.__dict__["_made_of"] = made_of
    return samples


def made_of(samples: DataFrame) -> Wide | Whole | None:
    """What ``samples`` were made of, if what needs arrays of samples can be made of that as well: one row a sample and channel is
    then never grouped again."""
    return samples.__dict__.get("_made_of")


def melt(wide: DataFrame, channels: list[str], keys: tuple[str, ...] = ("recording", "sample")) -> DataFrame:
    """Samples from one column a channel. Rows are exploded where they are: an unpivot would make Spark forget by what they are
    dealt out, so that each grouping by recording and channel, or sample, shuffled all samples once more."""
    cells = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels))
    found = wide.select(*keys, F.explode(cells).alias("cell")).select(*keys[:-1], "cell.channel", keys[-1], "cell.value")
    plain = channels and not {*keys, "channel", "value", "block"} & set(channels)
    return remember(found, Wide(wide, list(channels))) if plain else found


def spread(samples: DataFrame, channels: list[str]) -> DataFrame:
    """One column a channel; the channels are named, so there is no pass over the data to find them."""
    own = made_of(samples)
    if isinstance(own, Wide) and set(channels) <= set(own.channels):
        return own.rows.select("recording", "sample", *(F.col(c).cast("double").alias(c) for c in channels))
    return samples.groupBy("recording", "sample").pivot("channel", channels).agg(F.first("value"))


def to_blocks(samples: DataFrame, size: int) -> DataFrame:
    """(recording, channel, block, start_sample, values): runs of ``size`` samples, in order."""
    block = F.floor(F.col("sample") / size).cast("long")
    grouped = samples.groupBy(*KEY, block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("s"))
    return grouped.select(*KEY, "block", F.col("s")[0]["sample"].alias("start_sample"), F.col("s.value").alias("values"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Samples of blocks."""
    return blocks.select(*KEY, "start_sample", F.posexplode("values").alias("i", "value")).select(*KEY, (F.col("start_sample") + F.col("i")).alias("sample"), "value")


def segments(samples: DataFrame, length: int, step: int) -> DataFrame:
    """(recording, channel, segment, values): windows of ``length`` samples every ``step``; full ones only."""
    last = F.floor(F.col("sample") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("sample") - length) / step) + 1)
    placed = samples.select(*KEY, "sample", "value", F.explode(F.sequence(first, last)).alias("segment"))
    grouped = placed.groupBy(*KEY, "segment").agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("s"))
    return grouped.where(F.size("s") == length).select(*KEY, "segment", F.col("s.value").alias("values"))


#: Samples of all channels, about, that are one row when segments are cut from rows with a column a channel.
CHUNK = 1 << 12


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def transformed(samples: DataFrame, length: int, step: int, transform: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """segments() with what ``transform`` makes of a matrix, a row a segment, in place of values, as the column ``name``.

    Of rows with a column a channel, stretches of a recording are gathered, each with the samples that its last segments reach
    into the next one; segments are cut in arrays, so that no sample is sent once for every segment that it is in."""
    own, kind = made_of(samples), dict(samples.dtypes)["recording"]
    schema = f"recording {kind}, channel string, segment long, `{name}` array<double>"
    if not isinstance(own, Wide) or step > length:

        def run(batches):
            for b in batches:
                if b.num_rows:
                    values = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, length).astype(float)
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], lists(transform(values))], names=[*KEY, "segment", name])

        return segments(samples, length, step).mapInArrow(run, schema)
    many, channels = max(1, CHUNK // step), own.channels
    size = many * step
    chunk = F.explode(F.sequence(F.greatest(F.floor((F.col("sample") - (length - step)) / size), F.lit(0)), F.floor(F.col("sample") / size))).alias("chunk")
    rows = own.rows.select("recording", chunk, F.struct(F.col("sample").cast("long").alias("sample"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(channels))).alias("s"))
    chunks = rows.groupBy("recording", "chunk").agg(F.sort_array(F.collect_list("s")).alias("s")).select("recording", "chunk", "s.sample", *(f"s.v{i}" for i in range(len(channels))))

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):  # a few chunks at a time, as segments overlap
                part = b.slice(at, 64)
                places, found = [], []
                for i, k in enumerate(part.column(1).to_pylist()):
                    sample, *values = (c[i].values.to_numpy(zero_copy_only=False) for c in part.columns[2:])
                    number = np.arange(max(k * many, -(-int(sample[0]) // step)), min((k + 1) * many - 1, (int(sample[-1]) + 1 - length) // step) + 1)
                    first = np.searchsorted(sample, number * step)
                    number, first = (x[np.searchsorted(sample, number * step + length) - first == length] for x in (number, first))
                    if len(number):
                        views = np.lib.stride_tricks.sliding_window_view(np.stack(values).astype(float), length, axis=1)
                        found.append(views[:, first].reshape(-1, length))
                        places.append((np.full(len(values) * len(number), i), np.repeat(np.arange(len(values)), len(number)), np.tile(number, len(values))))
                if found:
                    row, channel, segment = (np.concatenate(x) for x in zip(*places, strict=True))
                    columns = [part.column(0).take(pa.array(row)), pa.array(channels, pa.string()).take(pa.array(channel)), pa.array(segment, pa.int64()), lists(transform(np.concatenate(found)))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "segment", name])

    return chunks.mapInArrow(cut, schema)


def pick(samples: DataFrame, channels: list[str]) -> DataFrame:
    """Only the channels named; a name that no row has is no error, as recordings may differ."""
    found, own = samples.where(F.col("channel").isin(channels)), made_of(samples)
    if isinstance(own, Wide) and set(own.channels) & set(channels):
        remember(found, Wide(own.rows, [c for c in own.channels if c in channels]))
    return found


def drop_channels(samples: DataFrame, channels: list[str]) -> DataFrame:
    found, own = samples.where(~F.col("channel").isin(channels)), made_of(samples)
    if isinstance(own, Wide) and set(own.channels) - set(channels):
        remember(found, Wide(own.rows, [c for c in own.channels if c not in channels]))
    return found


def pick_types(samples: DataFrame, channels: DataFrame, kinds: list[str], exclude_bad: bool = True) -> DataFrame:
    """Samples of channels whose type is one of ``kinds``; ``channels``: recording, channel, ch_type, bad."""
    wanted = channels.where(F.col("ch_type").isin(kinds))
    if exclude_bad:
        wanted = wanted.where(~F.coalesce("bad", F.lit(False)))
    return samples.join(wanted.select(*KEY).distinct(), KEY, "left_semi")


def crop(samples: DataFrame, tmin: float, tmax: float, sfreq: float) -> DataFrame:
    """Samples in [tmin, tmax), counted from 0 again."""
    a, b = (time_to_index(F.lit(float(t)), sfreq) for t in (tmin, tmax))
    return samples.where((F.col("sample") >= a) & (F.col("sample") < b)).withColumn("sample", F.col("sample") - a)


def append(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``second`` after ``first`` in time, recording by recording, and the seams (recording, sample)."""
    ends = first.groupBy("recording").agg((F.max("sample") + 1).alias("end"))
    moved = second.join(ends, "recording").withColumn("sample", F.col("sample") + F.col("end")).drop("end")
    return first.unionByName(moved.select(first.columns)), ends.withColumnRenamed("end", "sample")


def rename_channels(samples: DataFrame, names: dict[str, str]) -> DataFrame:
    mapping = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return samples.withColumn("channel", F.coalesce(F.try_element_at(mapping, F.col("channel")), F.col("channel")))


def add_channel(samples: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """One more channel: a weighted sum of others at each sample."""
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    summed = samples.where(F.col("channel").isin(list(weights))).groupBy("recording", "sample").agg(F.sum(F.col("value") * F.element_at(w, F.col("channel"))).alias("value"))
    return samples.unionByName(summed.withColumn("channel", F.lit(name)).select(samples.columns))
