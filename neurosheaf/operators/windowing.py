"""Windows of fixed length, runs of samples, and intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept
from .signals import KEY, Whole, in_order, made_of
from .statistics import MAD_SCALE


def window_table(samples: DataFrame, length: int) -> DataFrame:
    """Standard deviation (population) and range of each full tumbling window of a channel."""
    window = F.floor(F.col("sample") / length).cast("long")
    found = samples.groupBy(*KEY, window.alias("window")).agg(F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("ptp"), F.count("*").alias("n"))
    return found.where(F.col("n") == length).drop("n")


def flat_fraction(windows: DataFrame, threshold: float) -> DataFrame:
    """Share of a channel's windows whose standard deviation is below the threshold."""
    return windows.groupBy(*KEY).agg(F.avg((F.col("std") < threshold).cast("double")).alias("flat_fraction"))


def amplitude_instability(windows: DataFrame) -> DataFrame:
    """MAD of the decimal logarithm of windows' standard deviations; 0 for fewer than three windows."""
    logs = windows.withColumn("l", F.log10(F.greatest("std", F.lit(1e-6))))
    middle = logs.withColumn("d", F.abs(F.col("l") - F.median("l").over(W.partitionBy(*KEY))))
    return middle.groupBy(*KEY).agg(F.when(F.count("*") < 3, 0.0).otherwise(MAD_SCALE * F.median("d")).alias("instability"))


def bad_window_fraction(windows: DataFrame, ptp: float, z: float = 5.0, channels: int = 4) -> DataFrame:
    """Share of windows with a range over ``ptp``, or a log deviation more than ``z`` robust deviations from the
    other channels' in the same window, if those are at least ``channels``."""
    peers = W.partitionBy("recording", "window")
    logs = windows.withColumn("l", F.log10(F.greatest("std", F.lit(1e-6)))).withColumns({"m": F.median("l").over(peers), "peers": F.count("*").over(peers)})
    scored = logs.withColumn("spread", MAD_SCALE * F.median(F.abs(F.col("l") - F.col("m"))).over(peers))
    outlier = (F.col("peers") >= channels) & (F.col("spread") > 1e-6) & (F.col("l") - F.col("m") > z * F.col("spread"))
    bad = (F.col("ptp") > ptp) | outlier
    return scored.groupBy(*KEY).agg(F.avg(bad.cast("double")).alias("bad_window_fraction"))


def runs(samples: DataFrame, state: Column, *more: Column) -> DataFrame:
    """(recording, channel, state, start, length, more): maximal runs of equal states at consecutive samples; ``more`` are aggregates over a run."""
    marked = samples.withColumn("state", state)
    order = in_order()
    same = F.col("state").eqNullSafe(F.lag("state").over(order)) & (F.lag("sample").over(order) == F.col("sample") - 1)
    numbered = marked.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy(*KEY, "_run", "state").agg(F.min("sample").alias("start"), F.count("*").alias("length"), *more).drop("_run")


def clipping_fraction(samples: DataFrame, least: int = 3) -> DataFrame:
    """Share of a channel's samples in runs of at least ``least`` at its own minimum or maximum; constant: 1."""
    # The order of runs() over the whole channel, so that samples are sorted once and not joined with anything.
    channel = in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = samples.select(*KEY, "sample", "value").withColumns({"lo": F.min("value").over(channel), "hi": F.max("value").over(channel)})
    at = F.coalesce((F.col("value") == F.col("lo")) | (F.col("value") == F.col("hi")), F.lit(False)).cast("int")
    found = runs(edges.withColumn("constant", F.col("lo") == F.col("hi")), at, F.max("constant").alias("constant"))
    clipped = F.coalesce(F.sum(F.when((F.col("state") > 0) & (F.col("length") >= least), F.col("length"))), F.lit(0))
    share = F.when(F.max("constant"), 1.0).otherwise(clipped / F.sum("length"))
    return found.groupBy(*KEY).agg(share.cast("double").alias("clipping_fraction"))


def merge_intervals(intervals: DataFrame, by: list[str], gap: Column | float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals at most ``gap`` apart put together: (by, start, end, parts)."""
    gap = F.lit(gap) if isinstance(gap, (int, float)) else gap
    before = W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    fresh = F.when(F.col(start) <= F.max(end).over(before) + gap, 0).otherwise(1)
    island = F.sum("_new").over(W.partitionBy(*by).orderBy(start, end))
    marked = intervals.withColumn("_new", fresh).withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def _ranges(whole: DataFrame, length: int, step: int) -> DataFrame:
    """hopping_extremes() of whole channels, where they are."""

    def run(batches):
        for b in batches:
            rows, windows, ranges = [], [], []
            for i, (start, numbers, values) in enumerate(zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True)):
                x = values.values.to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                sample = numbers.values.to_numpy() if numbers.is_valid else start + np.arange(len(x))
                window = np.arange(max(0, -(-int(sample[0]) // step)), (int(sample[-1]) + 1 - length) // step + 1)
                first = np.searchsorted(sample, window * step)
                full = np.searchsorted(sample, window * step + length) - first == length
                if full.any():
                    cut = np.lib.stride_tricks.sliding_window_view(x, length)[first[full]]
                    rows.append(np.full(len(cut), i))
                    windows.append(window[full])
                    ranges.append(np.ptp(cut, axis=1))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(windows), pa.int64()), pa.array(np.concatenate(ranges))], names=[*KEY, "window", "ptp"])

    return whole.select(*KEY, "start", "numbers", "values").mapInArrow(run, f"recording {dict(whole.dtypes)['recording']}, channel string, window long, ptp double")


def hopping_extremes(samples: DataFrame, length: int, step: int) -> DataFrame:
    """Range of each full window of ``length`` samples every ``step``."""
    own = made_of(samples)
    if isinstance(own, Whole):
        return _ranges(own.blocks, length, step)
    last, first = F.floor(F.col("sample") / step), F.greatest(F.lit(0), F.floor((F.col("sample") - length) / step) + 1)
    placed = samples.select(*KEY, "value", F.explode(F.sequence(first, last)).alias("window"))
    found = placed.groupBy(*KEY, "window").agg((F.max("value") - F.min("value")).alias("ptp"), F.count("*").alias("n"))
    return found.where(F.col("n") == length).drop("n")


def amplitude_intervals(samples: DataFrame, length: int, step: int, high: float, low: float, channels: int = 1) -> DataFrame:
    """(recording, description, start, end) in samples: windows in which at least ``channels`` channels range over
    ``high`` (BAD_amplitude) or below ``low`` (BAD_flat), overlapping ones merged."""
    kind = F.when(F.col("ptp") > high, "BAD_amplitude").when(F.col("ptp") < low, "BAD_flat")
    counted = hopping_extremes(samples, length, step).withColumn("description", kind).where("description is not null")
    found = counted.groupBy("recording", "description", "window").agg(F.count("*").alias("n")).where(F.col("n") >= channels)
    spans = found.select("recording", "description", (F.col("window") * step).alias("start"), (F.col("window") * step + length).alias("end"))
    return merge_intervals(spans, ["recording", "description"], 0)


def stim_events(samples: DataFrame, least: int = 1, mask: int | None = None) -> DataFrame:
    """(recording, channel, sample, previous, code) where a trigger line turns to another value that isn't zero.

    A line that is never zero rests at its most frequent value (the smallest of equals), which then
    counts as zero. Runs of fewer than ``least`` samples are no events.
    """
    code = F.rint("value").cast("long")
    coded = samples.withColumn("code", code if mask is None else code.bitwiseAND(F.lit(mask).cast("long")))
    # A line without zeros has the same runs before its rest counts as zero: what it rests at is told by runs, not by samples once more.
    held = runs(coded.select(*KEY, "sample", "code"), F.col("code"))
    line = W.partitionBy(*KEY)
    counted = held.withColumn("n", F.sum("length").over(W.partitionBy(*KEY, "state")))
    counted = counted.withColumns({"zero": F.max((F.col("state") == 0).cast("int")).over(line), "rest": F.max_by("state", F.struct("n", -F.col("state"))).over(line)})
    found = counted.withColumn("state", F.when((F.col("zero") == 0) & (F.col("state") == F.col("rest")), 0).otherwise(F.col("state")))
    previous = F.coalesce(F.lag("state").over(W.partitionBy(*KEY).orderBy("start")), F.lit(0))
    marked = found.withColumn("previous", previous)
    return marked.where((F.col("state") != 0) & (F.col("length") >= least)).select(*KEY, F.col("start").alias("sample"), "previous", F.col("state").alias("code"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """Adds place (long, from 1) in the order of a column. Rows are dealt out by ranges of it and numbered inside each; a
    row a range tells how many come before."""
    dealt = kept(df.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # As many rows as there are partitions.
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("place", F.row_number().over(W.partitionBy("_range").orderBy(column)))
    return inside.join(before, "_range").withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_before")
