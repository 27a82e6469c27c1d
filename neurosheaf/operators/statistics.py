"""Robust statistics and per-channel tables; every percentile is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signals import KEY

#: A median absolute deviation times this estimates a standard deviation of normal data.
MAD_SCALE = 1.4826


def channel_table(samples: DataFrame) -> DataFrame:
    """Mean, population standard deviation, minimum and maximum of finite values, and how many aren't."""
    v = F.col("value")
    finite = F.when(~(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), v)
    stats = {"mean": F.avg(finite), "std": F.stddev_pop(finite), "min": F.min(finite), "max": F.max(finite)}
    return samples.groupBy(*KEY).agg(F.count("*").alias("n"), *(f.alias(n) for n, f in stats.items()), (F.count("*") - F.count(finite)).alias("n_missing"))


def mad(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, median, mad): medians, and scaled medians of the distance from them."""
    middle = df.groupBy(*by).agg(F.median(value).alias("median"))
    away = df.join(middle, by).groupBy(*by, "median").agg((MAD_SCALE * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad"))
    return away.select(*by, "median", "mad")


def robust_std(value: Column) -> Column:
    """0.7413 times the range between quartiles."""
    return 0.7413 * (F.percentile(value, 0.75) - F.percentile(value, 0.25))


def robust_z(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """Adds (value - median) / MAD within groups; where the MAD is zero by the standard deviation; where that is, 0."""
    group = W.partitionBy(*by)
    middle = df.withColumn("_m", F.median(value).over(group)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    scaled = middle.withColumns({"_mad": MAD_SCALE * F.median("_d").over(group), "_std": F.stddev_pop(value).over(group)})
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad")).when(F.col("_std") > 1e-12, F.col("_std"))
    return scaled.withColumn(out, F.coalesce((F.col(value) - F.col("_m")) / scale, F.lit(0.0))).drop("_m", "_d", "_mad", "_std")


def excess_kurtosis(value: Column) -> Column:
    """Corrected for bias; null below four values or without variance."""
    n = F.count(value).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def moments(samples: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis, and the latter corrected for bias."""
    v = F.col("value")
    return samples.groupBy(*KEY).agg(F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), excess_kurtosis(v).alias("excess_kurtosis"))


def ramp(value: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, linear between and clipped; missing: 0. ``low`` may be the larger."""
    x = (value - F.lit(float(low))) / F.lit(float(high - low))
    return F.coalesce(F.when(~F.isnan(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))


def grade(score: Column) -> Column:
    """good from 75, fair from 50, poor from 25, else bad."""
    return F.when(score >= 75, "good").when(score >= 50, "fair").when(score >= 25, "poor").otherwise("bad")
