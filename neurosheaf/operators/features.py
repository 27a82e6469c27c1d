"""Features of a channel's time course, in DataFrame expressions; one sort a channel serves them all."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signals import KEY, in_order


def time_features(samples: DataFrame, sfreq: float) -> DataFrame:
    """Line length, zero crossings a second, Hjorth's activity, mobility and complexity, RMS and range.

    A constant channel has no mobility or complexity (null).
    """
    order = in_order()
    # Summed in the order of samples, so that a channel whose mean is one of its values gives the same wherever its rows come from.
    mean = F.avg("value").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    steps = samples.withColumns({"d": F.col("value") - F.lag("value").over(order), "below": (F.col("value") - mean < 0).cast("int")})
    steps = steps.withColumns({"d2": F.col("d") - F.lag("d").over(order), "crossed": (F.col("below") != F.lag("below").over(order)).cast("int")})
    sums = steps.groupBy(*KEY).agg(
        F.avg(F.abs("d")).alias("line_length"),
        F.sum("crossed").alias("crossings"),
        F.count("*").alias("n"),
        *(F.var_pop(c).alias(v) for c, v in (("value", "v0"), ("d", "v1"), ("d2", "v2"))),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"),
        (F.max("value") - F.min("value")).alias("ptp"),
    )
    mobility = F.when(F.col("v0") > 0, F.sqrt(F.col("v1") / F.col("v0")))
    complexity = F.when((F.col("v1") > 0) & (F.col("v0") > 0), F.sqrt(F.col("v2") / F.col("v1")) / mobility)
    return sums.select(*KEY, "line_length", (F.col("crossings") * float(sfreq) / F.col("n")).alias("zero_crossing_rate"), F.col("v0").alias("activity"), mobility.alias("mobility"), complexity.alias("complexity"), "rms", "ptp")


def permutation_entropy(samples: DataFrame, order: int = 3) -> DataFrame:
    """Entropy of the order patterns of ``order`` values in a row, as a share of the largest possible; ties keep their order."""
    spec, names = in_order(), [f"x{i}" for i in range(order)]
    rows = samples.select(*KEY, *(F.lead("value", i).over(spec).alias(n) for i, n in enumerate(names))).where(F.col(names[-1]).isNotNull())
    # A pattern is, for each value, how many come before it in sorted order.
    ranks = [sum(((F.col(names[j]) <= F.col(names[i])) if j < i else (F.col(names[j]) < F.col(names[i]))).cast("int") for j in range(order) if j != i) for i in range(order)]
    pattern = sum(r * order**i for i, r in enumerate(ranks))
    counts = rows.groupBy(*KEY, pattern.alias("pattern")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(W.partitionBy(*KEY))
    shares = counts.withColumn("p", F.col("c") / total)
    most = math.log2(len(list(permutations(range(order)))))
    return shares.groupBy(*KEY).agg((-F.sum(F.col("p") * F.log2("p")) / most).alias("permutation_entropy"))


def katz_fd(samples: DataFrame) -> DataFrame:
    """Katz's fractal dimension; null for a constant channel."""
    order = in_order()
    first = F.first_value("value").over(order)
    steps = samples.select(*KEY, F.abs(F.col("value") - F.lag("value").over(order)).alias("d"), F.abs(F.col("value") - first).alias("away"))
    sums = steps.groupBy(*KEY).agg(F.sum("d").alias("length"), F.avg("d").alias("mean"), F.max("away").alias("reach"))
    n = F.log10(F.col("length") / F.col("mean"))
    return sums.select(*KEY, F.when((F.col("length") > 0) & (F.col("reach") > 0), n / (n + F.log10(F.col("reach") / F.col("length")))).alias("katz_fd"))


def higuchi_fd(samples: DataFrame, kmax: int = 10) -> DataFrame:
    """Higuchi's fractal dimension: the slope of log curve length on log 1/k."""
    order = in_order()
    n = F.count("*").over(W.partitionBy(*KEY))
    lagged = samples.select(*KEY, "sample", n.alias("n"), *(F.abs(F.col("value") - F.lag("value", k).over(order)).alias(f"d{k}") for k in range(1, kmax + 1)))
    strides = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("d")) for k in range(1, kmax + 1)))
    steps = lagged.select(*KEY, "sample", "n", F.explode(strides).alias("s")).select(*KEY, "n", "s.k", "s.d", (F.col("sample") % F.col("s.k")).alias("m"))
    curves = steps.groupBy(*KEY, "n", "k", "m").agg(F.sum("d").alias("d"), F.count("*").alias("c")).where("c > 1")
    lengths = curves.withColumn("length", F.col("d") * (F.col("n") - 1) / ((F.col("c") - 1) * F.col("k")) / F.col("k"))
    means = lengths.groupBy(*KEY, "k").agg(F.avg("length").alias("length")).where("length > 0")
    return means.groupBy(*KEY).agg(F.regr_slope(F.ln("length"), F.ln(1 / F.col("k"))).alias("higuchi_fd"))


def _sample_entropy(x: np.ndarray, m: int, r: float) -> float:
    n, tolerance = len(x) - m, r * x.std()
    if n < 2 or tolerance == 0:
        return math.nan
    shorter = longer = 0
    for i in range(n - 1):
        near = np.ones(n - 1 - i, bool)
        for k in range(m):
            near &= np.abs(x[i + 1 + k : n + k] - x[i + k]) <= tolerance
        shorter += int(near.sum())
        longer += int((near & (np.abs(x[i + 1 + m : n + m] - x[i + m]) <= tolerance)).sum())
    if not shorter:
        return math.nan
    return -math.log(longer / shorter) if longer else math.inf


def sample_entropy(samples: DataFrame, m: int = 2, r: float = 0.2, first: int = 3000) -> DataFrame:
    """Sample entropy of the first ``first`` samples of each channel (that many bound the quadratic work, by definition
    of the feature). Without any similar pair: null; none that stays similar: infinity."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("sample").value.to_numpy(float)
        return pd.DataFrame({"recording": [rows.recording.iloc[0]], "channel": [rows.channel.iloc[0]], "sample_entropy": [_sample_entropy(x, m, r)]})

    kind = dict(samples.dtypes)
    found = samples.where(F.col("sample") < first).groupBy(*KEY).applyInPandas(run, f"recording {kind['recording']}, channel string, sample_entropy double")
    return found.withColumn("sample_entropy", F.when(~F.isnan("sample_entropy"), F.col("sample_entropy")))


def channel_features(samples: DataFrame, sfreq: float, seconds: float = 2.0) -> DataFrame:
    """One row a channel: features of the time course and of its spectrum, powers of bands in wide form and their ratios."""
    from . import spectral
    from .statistics import moments

    psd = spectral.welch(samples, sfreq, seconds)
    bands = {k: v for k, v in spectral.BANDS.items() if v[0] < sfreq / 2}
    power = spectral.band_power(psd, bands).groupBy(*KEY).pivot("band", list(bands)).agg(F.first("power").alias("power"), F.first("relative").alias("relative"))
    ratio = lambda a, b: F.when(F.col(f"{b}_power") > 0, F.col(f"{a}_power") / F.col(f"{b}_power"))
    if {"theta", "alpha", "beta"} <= set(bands):
        power = power.withColumns({"theta_beta": ratio("theta", "beta"), "alpha_theta": ratio("alpha", "theta")})
    tables = [moments(samples), permutation_entropy(samples), katz_fd(samples), higuchi_fd(samples), power, spectral.spectral_edge(psd), spectral.spectral_entropy(psd), spectral.peak_frequency(psd), spectral.fit_aperiodic(psd)]
    out = time_features(samples, sfreq)
    for t in tables:
        out = out.join(t, KEY, "left")
    return out
