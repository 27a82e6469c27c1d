"""Spectra: Welch, periodogram and multitaper estimates, and what is read off them.

Segments are arrays; numpy transforms a batch of them at a time wherever they are, so that only the
averages over segments are shuffled. A spectrum is rows (recording, channel, freq, power).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import filters
from .signals import KEY, segments, transformed

#: The usual frequency bands in Hz, both edges included.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def _power(cut: DataFrame, length: int, transform) -> DataFrame:
    """power (array) in place of values (array of ``length``)."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("values")
            values = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(float)
            power = transform(values)
            flat = pa.array(power.ravel())
            offsets = pa.array(np.arange(len(power) + 1, dtype=np.int32) * power.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.ListArray.from_arrays(offsets, flat)], names=[*(n for n in b.schema.names if n != "values"), "power"])

    kept = [(n, k) for n, k in cut.dtypes if n != "values"]
    return cut.select(*(n for n, _ in kept), "values").mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kept) + ", power array<double>")


def _one_sided(power: np.ndarray, n: int) -> np.ndarray:
    power[:, 1 : (None if n % 2 else -1)] *= 2
    return power


def densities(length: int, sfreq: float) -> Callable[[np.ndarray], np.ndarray]:
    """Hann-windowed power densities of segments without their mean."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    scale = 1 / (sfreq * (window**2).sum())
    return lambda x: _one_sided(np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 * scale, length)


def periodograms(cut: DataFrame, length: int, sfreq: float) -> DataFrame:
    """Densities of segments that are there already."""
    return _power(cut, length, densities(length, sfreq))


def multitapers(cut: DataFrame, length: int, sfreq: float, bandwidth: float | None = None) -> DataFrame:
    """Power densities of segments, averaged over Slepian tapers by their concentrations."""
    seconds = length / sfreq
    nw = max(1.0, (bandwidth or 4 / seconds) * seconds / 2)
    own, weight = filters.tapers(length, nw, max(1, int(2 * nw) - 1))
    weight = weight / weight.sum()

    def transform(x: np.ndarray) -> np.ndarray:
        spectra = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True))[:, None, :] * own, axis=2)) ** 2
        return _one_sided(np.einsum("k,skf->sf", weight, spectra) / sfreq, length)

    return _power(cut, length, transform)


def averaged(power: DataFrame, length: int, sfreq: float, average: str = "mean", by: list[str] = KEY) -> DataFrame:
    """(by, freq, power) from segments' power; the median is divided by its bias over independent segments."""
    bins = power.select(*by, F.posexplode("power").alias("bin", "p"))
    if average == "mean":
        found = bins.groupBy(*by, "bin").agg(F.avg("p").alias("power"))
    else:
        terms = F.sequence(F.lit(1), F.greatest(F.floor((F.count("*") - 1) / 2).cast("int"), F.lit(1)))
        bias = F.when(F.count("*") < 3, 1.0).otherwise(F.aggregate(terms, F.lit(1.0), lambda a, i: a + 1 / (2 * i + 1) - 1 / (2 * i)))
        found = bins.groupBy(*by, "bin").agg((F.median("p") / bias).alias("power"))
    return found.select(*by, (F.col("bin") * F.lit(sfreq / length)).alias("freq"), "power")


def welch(samples: DataFrame, sfreq: float, seconds: float, overlap: float = 0.5, average: str = "mean") -> DataFrame:
    """Welch's estimate over windows of ``seconds``; channels shorter than a window give no rows."""
    length = max(8, round(seconds * sfreq))
    return averaged(transformed(samples, length, length - round(length * overlap), densities(length, sfreq), "power"), length, sfreq, average)


def band_power(psd: DataFrame, bands: dict[str, tuple[float, float]] = BANDS, by: list[str] = KEY) -> DataFrame:
    """(by, band, power, relative): area under the spectrum between a band's edges, and as a share of the area between the
    lowest and highest edge of all; bands with fewer than two bins are left out."""
    order = W.partitionBy(*by).orderBy("freq")
    strips = psd.withColumns({"f2": F.lead("freq").over(order), "p2": F.lead("power").over(order)}).where("f2 is not null")
    area = (F.col("f2") - F.col("freq")) * (F.col("power") + F.col("p2")) / 2
    inside = lambda lo, hi: F.sum(F.when((F.col("freq") >= lo) & (F.col("f2") <= hi), area))
    lo, hi = min(b[0] for b in bands.values()), max(b[1] for b in bands.values())
    wide = strips.groupBy(*by).agg(inside(lo, hi).alias("_total"), *(inside(*b).alias(n) for n, b in bands.items()))
    long = wide.unpivot([*by, "_total"], list(bands), "band", "power").where("power is not null")
    return long.select(*by, "band", "power", F.when(F.col("_total") > 0, F.col("power") / F.col("_total")).alias("relative"))


def spectral_edge(psd: DataFrame, share: float = 0.95, fmax: float = 45.0, by: list[str] = KEY) -> DataFrame:
    """The first frequency up to which a share of the power below ``fmax`` lies."""
    below = psd.where(F.col("freq") <= fmax)
    running = F.sum("power").over(W.partitionBy(*by).orderBy("freq"))
    total = F.sum("power").over(W.partitionBy(*by))
    return below.withColumn("_r", running >= share * total).where("_r").groupBy(*by).agg(F.min("freq").alias("spectral_edge"))


def spectral_entropy(psd: DataFrame, low: float = 1.0, high: float = 45.0, by: list[str] = KEY) -> DataFrame:
    """Entropy of the power's distribution over bins, as a share of the largest possible."""
    inside = psd.where(F.col("freq").between(low, high)).withColumn("p", F.col("power") / F.sum("power").over(W.partitionBy(*by)))
    return inside.groupBy(*by).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)) / F.log2(F.count("*").cast("double"))).alias("spectral_entropy"))


def peak_frequency(psd: DataFrame, low: float = 7.0, high: float = 14.0, by: list[str] = KEY) -> DataFrame:
    """The frequency of most power in a range (the first of equals), and the centroid there."""
    inside = psd.where(F.col("freq").between(low, high))
    return inside.groupBy(*by).agg(F.max_by("freq", F.struct("power", -F.col("freq"))).alias("peak_frequency"), (F.sum(F.col("freq") * F.col("power")) / F.sum("power")).alias("centroid"))


def aperiodic(psd: DataFrame, low: float = 2.0, high: float = 40.0, by: list[str] = KEY) -> DataFrame:
    """Exponent and offset of the 1/f background: a line through log power on log frequency, fitted again without the
    bins that stand above the first line by more than 0.05 plus the third quartile of the residuals."""
    logs = psd.where(F.col("freq").between(low, high) & (F.col("power") > 0)).select(*by, F.log10("freq").alias("x"), F.log10("power").alias("y"))
    line = logs.groupBy(*by).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    off = logs.join(line, by).withColumn("r", F.col("y") - F.col("s") * F.col("x") - F.col("i"))
    kept = off.withColumn("q", F.percentile("r", 0.75).over(W.partitionBy(*by))).where("r < q + 0.05")
    return kept.groupBy(*by).agg((-F.regr_slope("y", "x")).alias("exponent"), F.regr_intercept("y", "x").alias("offset"))


def fit_aperiodic(psd: DataFrame, low: float = 1.0, high: float = 45.0, rounds: int = 3, by: list[str] = KEY) -> DataFrame:
    """Exponent and offset of the 1/f background by a line that is fitted again without the bins above it: those with a residual
    over 0.02 plus the 60th percentile of the residuals (if that is above zero) go, while four bins are left."""
    logs = psd.where(F.col("freq").between(low, high) & (F.col("power") > 0)).select(*by, F.log10("freq").alias("x"), F.log10("power").alias("y"))
    group = W.partitionBy(*by)
    table = logs.withColumn("u", F.lit(True))
    for _ in range(rounds):
        x, y = F.when(F.col("u"), F.col("x")), F.when(F.col("u"), F.col("y"))
        slope = F.covar_pop(x, y).over(group) / F.nullif(F.var_pop(x).over(group), F.lit(0.0))
        table = table.withColumn("s", slope).withColumn("i", F.avg(y).over(group) - F.col("s") * F.avg(x).over(group)).withColumn("r", F.col("y") - F.col("s") * F.col("x") - F.col("i"))
        limit = F.greatest(F.percentile(F.when(F.col("u"), F.col("r")), 0.6).over(group), F.lit(0.0)) + 0.02
        table = table.withColumn("k", F.col("u") & (F.col("r") <= limit)).withColumn("u", F.when(F.count(F.when(F.col("k"), 1)).over(group) >= 4, F.col("k")).otherwise(F.col("u")))
    return table.where("u").groupBy(*by).agg((-F.regr_slope("y", "x")).alias("exponent"), F.regr_intercept("y", "x").alias("offset"))


def welch_without_bad(samples: DataFrame, spans: DataFrame, sfreq: float, seconds: float, overlap: float = 0.5) -> DataFrame:
    """Welch's estimate over the stretches between bad spans (recording, start, end), averaged by their lengths; stretches
    shorter than a window are left out."""
    from .annotations import without_bad
    from .signals import in_order

    good = without_bad(samples, spans).withColumn("_stretch", F.col("sample") - F.row_number().over(in_order()))
    first = F.min("sample").over(W.partitionBy(*KEY, "_stretch"))
    apart = good.select("recording", F.concat_ws("\x00", F.col("channel"), first.cast("string")).alias("channel"), (F.col("sample") - first).alias("sample"), "value")
    lengths = apart.groupBy(*KEY).agg(F.count("*").alias("n"))
    each = welch(apart, sfreq, seconds, overlap).join(lengths, KEY).withColumn("channel", F.split("channel", "\x00")[0])
    return each.groupBy(*KEY, "freq").agg((F.sum(F.col("power") * F.col("n")) / F.sum("n")).alias("power"))


def mean_between(low: float, high: float) -> Column:
    return F.avg(F.when(F.col("freq").between(low, high), F.col("power")))


def line_noise_db(psd: DataFrame, line: float = 50.0, by: list[str] = KEY) -> DataFrame:
    """The peak within 1 Hz of the mains over the median of the bins 3 to 8 Hz away."""
    away = F.abs(F.col("freq") - line)
    found = psd.groupBy(*by).agg(F.max(F.when(away <= 1, F.col("power"))).alias("p"), F.median(F.when(away.between(3, 8), F.col("power"))).alias("m"))
    return found.select(*by, F.when((F.col("p") > 0) & (F.col("m") > 0), 10 * F.log10(F.col("p") / F.col("m"))).alias("line_noise_db"))


def snr_db(psd: DataFrame, line: float = 50.0, signal: tuple[float, float] = (1.0, 30.0), noise: tuple[float, float] = (45.0, 95.0), by: list[str] = KEY) -> DataFrame:
    """Mean density in the signal's band over that in the noise's, less what lies within 2 Hz of the mains and its harmonics."""
    away = F.abs(F.col("freq") - line * F.rint(F.col("freq") / line))
    found = psd.groupBy(*by).agg(mean_between(*signal).alias("s"), F.avg(F.when(F.col("freq").between(*noise) & (away > 2), F.col("power"))).alias("n"))
    return found.select(*by, F.when((F.col("s") > 0) & (F.col("n") > 0), 10 * F.log10(F.col("s") / F.col("n"))).alias("snr_db"))


def dominant_bands(psd: DataFrame, bands: dict[str, tuple[float, float]] = BANDS, by: list[str] = KEY) -> DataFrame:
    """The band of the largest relative power (the first by name of equals)."""
    return band_power(psd, bands, by).groupBy(*by).agg(F.max_by(F.struct("band", "relative"), F.struct("relative", F.col("band"))).alias("b")).select(*by, "b.band", "b.relative")


def spectrogram(samples: DataFrame, sfreq: float, seconds: float, step: float) -> DataFrame:
    """(recording, channel, segment, time, freq, power): power densities of windows every ``step`` seconds."""
    length, hop = max(8, round(seconds * sfreq)), max(1, round(step * sfreq))
    power = periodograms(segments(samples, length, hop), length, sfreq)
    time = (F.col("segment") * hop + length / 2) / sfreq
    return power.select(*KEY, "segment", time.alias("time"), F.posexplode("power").alias("bin", "power")).select(*KEY, "segment", "time", (F.col("bin") * F.lit(sfreq / length)).alias("freq"), "power")


def morlet_power(cut: DataFrame, length: int, sfreq: float, frequencies: list[float], cycles: float = 7.0) -> DataFrame:
    """Mean wavelet power of each segment at frequencies, in their order."""
    return _power(cut, length, lambda x: np.array([(np.abs(filters.morlet(row, sfreq, frequencies, cycles)) ** 2).mean(axis=1) for row in x]).reshape(-1, len(frequencies)))
