"""Operators across channels: references, spatially linear maps, neighbours."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import montage
from . import blockwise
from .signals import KEY, Whole, made_of, remember

#: Rows of a table of weights that are broadcast (the square of a montage's channels); a larger table is joined.
BROADCAST_WEIGHTS = 100_000


#: The chains of electrodes of the two clinical bipolar montages, longitudinal and transverse.
CHAINS = {
    "double_banana": ["Fp1 F7 T7 P7 O1", "Fp2 F8 T8 P8 O2", "Fp1 F3 C3 P3 O1", "Fp2 F4 C4 P4 O2", "Fz Cz Pz"],
    "transverse": ["F7 Fp1 Fp2 F8", "F7 F3 Fz F4 F8", "T7 C3 Cz C4 T8", "P7 P3 Pz P4 P8", "O1 O2"],
}
BIPOLAR = {name: [p for chain in chains for p in pairwise(chain.split())] for name, chains in CHAINS.items()}


def set_reference(samples: DataFrame, reference: str | list[str] = "average", bad: list[str] | None = None, channels: DataFrame | None = None, drop: bool = False) -> DataFrame:
    """Values minus the mean (average) or median of the good channels at each sample, or the mean of named channels.

    Bad channels are re-referenced too but aren't pooled. With a table of ``channels`` (recording, channel, ch_type, bad), its
    EEG channels only are re-referenced, those of them that aren't bad are pooled, and the others stay as they are. ``drop``
    leaves out the named channels afterwards.
    """
    own = made_of(samples)
    if isinstance(own, Whole) and own.short and reference == "average":
        return _less_average(own.blocks, bad, channels)
    sample = W.partitionBy("recording", "sample")
    names = [] if reference in ("average", "median") else [reference] if isinstance(reference, str) else list(reference)
    own = samples
    eeg, good = F.lit(True), ~F.col("channel").isin(bad) if bad else F.lit(True)
    if channels is not None:
        own = samples.join(channels.select("recording", "channel", (F.col("ch_type") == "eeg").alias("_eeg"), F.col("bad").alias("_bad")), ["recording", "channel"], "left")
        eeg = F.coalesce("_eeg", F.lit(False))
        good = eeg & (good if bad is not None else ~F.coalesce("_bad", F.lit(False)))
    pooled = F.when(F.col("channel").isin(names) if names else good, F.col("value"))
    level = (F.median if reference == "median" else F.avg)(pooled).over(sample)
    out = own.withColumn("value", F.when(eeg, F.col("value") - F.coalesce(level, F.lit(0.0))).otherwise(F.col("value"))).select(samples.columns)
    return out.where(~F.col("channel").isin(names)) if drop and names else out


def _less_average(blocks: DataFrame, bad: list[str] | None, channels: DataFrame | None) -> DataFrame:
    """set_reference() by the average, of whole short channels: arrays of a recording's channels are shuffled, not samples."""
    told = blocks.select(*KEY, "block", "start", "numbers", "values")
    eeg, good = F.lit(True), ~F.col("channel").isin(bad) if bad else F.lit(True)
    if channels is not None:
        told = told.join(channels.select(*KEY, (F.col("ch_type") == "eeg").alias("_eeg"), F.col("bad").alias("_bad")), KEY, "left")
        eeg = F.coalesce("_eeg", F.lit(False))
        good = eeg & (good if bad is not None else ~F.coalesce("_bad", F.lit(False)))
    told = told.select(*KEY, "block", F.lit(False).alias("coded"), "start", "numbers", "values", eeg.alias("changed"), F.coalesce(good, F.lit(False)).alias("pooled"))

    def run(key, table):
        x = [v.values.to_numpy(zero_copy_only=False).astype(float) for v in table["values"].combine_chunks()]
        told_numbers, starts = table["numbers"].to_pylist(), table["start"].to_pylist()
        numbers = [start + np.arange(len(v)) if n is None else np.array(n) for n, start, v in zip(told_numbers, starts, x, strict=True)]
        every, at = np.unique(np.concatenate(numbers), return_inverse=True)
        at = np.split(at, np.cumsum([len(v) for v in x])[:-1])
        total, count = np.zeros(len(every)), np.zeros(len(every))
        for v, place, pooled in zip(x, at, table["pooled"].to_pylist(), strict=True):
            if pooled:
                total[place] += v
                count[place] += 1
        level = np.divide(total, count, out=np.zeros(len(every)), where=count > 0)
        made = [v - level[place] if changed else v for v, place, changed in zip(x, at, table["changed"].to_pylist(), strict=True)]
        return table.select([*KEY, "block", "coded", "start", "numbers"]).append_column("values", pa.array(made, pa.list_(pa.float64())))

    kind = dict(blocks.dtypes)["recording"]
    made = told.groupBy("recording").applyInArrow(run, f"recording {kind}, channel string, block long, coded boolean, start long, numbers array<long>, values array<double>")
    return remember(blockwise.from_blocks(made), Whole(made, True))


def add_reference_channel(samples: DataFrame, name: str) -> DataFrame:
    """One more channel of zeros: the recording's own reference."""
    zeros = samples.select("recording", "sample").distinct().select("recording", F.lit(name).alias("channel"), "sample", F.lit(0.0).alias("value"))
    return samples.unionByName(zeros.select(samples.columns))


def bipolar(samples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Anode minus cathode for each pair of which both are there, named ``anode-cathode``."""
    used = sorted({c for p in pairs for c in p})
    values = F.map_from_entries(F.collect_list(F.struct("channel", "value")))
    wide = samples.where(F.col("channel").isin(used)).groupBy("recording", "sample").agg(values.alias("v"))
    made = F.array(*(F.struct(F.lit(f"{a}-{c}").alias("channel"), (F.try_element_at("v", F.lit(a)) - F.try_element_at("v", F.lit(c))).alias("value")) for a, c in pairs))
    return wide.select("recording", "sample", F.explode(made).alias("p")).select("recording", "p.channel", "sample", "p.value").where("value is not null")


def apply_weights(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """The channels that weights (output, channel, weight) make; an output lacks where one of its channels does."""
    sized = weights.select("output", "channel", "weight")
    if sized.count() <= BROADCAST_WEIGHTS:
        sized = F.broadcast(sized)
    parts = samples.join(sized, "channel").select("recording", F.col("output").alias("channel"), "sample", (F.col("value") * F.col("weight")).alias("value"))
    return parts.groupBy("recording", "channel", "sample").agg(F.sum("value").alias("value"))


def neighbours(positions: DataFrame, k: int = 4, max_angle: float | None = None) -> DataFrame:
    """(channel, neighbour, angle, place): the ``k`` nearest other channels by angle, ties by name.

    ``positions``: channel, x, y, z on the unit sphere; a montage, so all its pairs are few.
    """
    other = positions.select(F.col("channel").alias("neighbour"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    cosine = sum(F.col(c) * F.col(f"{c}2") for c in "xyz")
    pairs = positions.join(F.broadcast(other), F.col("channel") != F.col("neighbour")).withColumn("angle", F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    if max_angle is not None:
        pairs = pairs.where(F.col("angle") <= max_angle)
    nearest = W.partitionBy("channel").orderBy(F.round("angle", 9), "neighbour")
    return pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).select("channel", "neighbour", "angle", "place")


def hjorth_weights(near: DataFrame) -> DataFrame:
    """Weights of the Hjorth Laplacian: each channel minus the mean of its neighbours."""
    share = -1.0 / F.count("*").over(W.partitionBy("channel"))
    others = near.select(F.col("channel").alias("output"), F.col("neighbour").alias("channel"), share.alias("weight"))
    own = near.select("channel").distinct().select(F.col("channel").alias("output"), "channel", F.lit(1.0).alias("weight"))
    return own.unionByName(others)


def _weights(spark, outputs: list[str], inputs: list[str], matrix: np.ndarray) -> DataFrame:
    rows = [(o, i, float(w)) for o, row in zip(outputs, matrix, strict=True) for i, w in zip(inputs, row, strict=True)]
    return spark.createDataFrame(rows, "output string, channel string, weight double")


def interpolation_weights(spark, good: dict[str, tuple], bad: dict[str, tuple]) -> DataFrame:
    """Weights that leave good channels and make bad ones from them; fewer than four good ones are an error."""
    if len(good) < 4:
        raise ValueError("at least four good channels are needed")
    made = montage.spline_weights(np.array(list(good.values())), np.array(list(bad.values())))
    own = spark.createDataFrame([(g, g, 1.0) for g in good], "output string, channel string, weight double")
    return own.unionByName(_weights(spark, list(bad), list(good), made))


def density_weights(spark, positions: dict[str, tuple]) -> DataFrame:
    """Weights of the current source density."""
    names = list(positions)
    return _weights(spark, names, names, montage.density_weights(np.array(list(positions.values()))))
