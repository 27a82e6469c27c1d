"""Channel quality from 0 to 100: metrics, the penalties they earn, a score, a grade, reasons and a rank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import filters
from ..session import kept
from . import blockwise, spectral, windowing
from .connectivity import both_ways
from .signals import KEY
from .statistics import MAD_SCALE, grade, ramp, robust_std, robust_z

#: Penalty, and the metric's values at which it begins and is full, and its size there.
RAMPS = {
    "flat": [("flat_fraction", 0.0, 0.5, 100)],
    "clipping": [("clipping_fraction", 0.0005, 0.01, 40)],
    "amplitude": [("abs_deviation", 3, 8, 40), ("amplitude", 60, 150, 40), ("amplitude", 2.0, 0.5, 25)],
    "correlation": [("neighbour_correlation", 0.6, 0.2, 40), ("corr_bad_fraction", 0.05, 0.5, 30)],
    "hf_noise": [("hf_noise_z", 3, 8, 35), ("snr_db", 15, 3, 35)],
    "line_noise": [("line_noise_db", 25, 45, 15)],
    "drift": [("drift_db", 12, 26, 20), ("relative_drift", 6, 15, 25)],
    "artifacts": [("bad_window_fraction", 0.02, 0.3, 30)],
    "spikes": [("local_kurtosis", 5, 20, 25)],
    "instability": [("instability", 0.25, 0.6, 15)],
    "spectrum": [("exponent", 0.6, 0.0, 10)],
}
ALWAYS = ("flat", "clipping")
#: A reason is given for a penalty of at least this.
REASON = 3.0


#: Windows of a recording, with all its channels, that are one group when channels are compared.
BLOCK_WINDOWS = 64
#: What described() gives a channel.
_DESCRIBED = """n_samples long, missing boolean, amplitude double, slow double, hf_ratio double, clipping_fraction double, whole_std double, windows array<long>, high_std array<double>,
 high_ptp array<double>, band_std array<double>, power array<double>, start long, band array<double>"""


def _spread(x: np.ndarray) -> float:
    """0.7413 times the range between quartiles."""
    low, high = np.percentile(x, [25, 75])
    return 0.7413 * (high - low)


def _scaled_mad(x: np.ndarray) -> float:
    return MAD_SCALE * float(np.median(np.abs(x - np.median(x))))


def _clipped(x: np.ndarray, sample: np.ndarray, least: int = 3) -> float:
    """Share of samples in runs of at least ``least`` at the lowest or highest value; constant: 1."""
    if x.min() == x.max():
        return 1.0
    at = (x == x.min()) | (x == x.max())
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(sample) != 1)])
    length = np.diff(np.r_[new, len(x)])
    return float(length[at[new] & (length >= least)].sum() / len(x))


def _median_welch(dense: np.ndarray, first: int, length: int, sfreq: float) -> np.ndarray | None:
    """spectral.welch(average="median", half overlap) of one channel: windows begin at multiples of their step, and have all their samples."""
    step = length - round(length * 0.5)
    begins = np.arange(-(-first // step) * step, first + len(dense) - length + 1, step) - first
    if not len(begins):
        return None
    cut = np.lib.stride_tricks.sliding_window_view(dense, length)[begins]
    cut = cut[np.isfinite(cut).all(axis=1)]
    if not len(cut):
        return None
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    power = np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2 / (sfreq * (hann**2).sum())
    power[:, 1 : (None if length % 2 else -1)] *= 2
    n = len(cut)
    pairs = np.arange(1, max((n - 1) // 2, 1) + 1)
    bias = 1.0 if n < 3 else 1.0 + (1 / (2 * pairs + 1) - 1 / (2 * pairs)).sum()
    return np.median(power, axis=0) / bias


def described(samples: DataFrame, sfreq: float, length: int, spectrum_seconds: float = 4.0, spectra: bool = True) -> DataFrame:
    """A row a channel (recording, channel, _DESCRIBED), from one pass over it: filtered above 1 Hz (high) and from 1 to 40 Hz (band).

    ``band`` begins at the sample ``start``, a multiple of ``length``, with NaN where there is no sample; ``windows`` are
    the numbers of the full windows of ``length``. Missing values count as 0, and ``missing`` tells of them. Without ``spectra`` power is null.
    """
    split = 50.0 if sfreq / 2 > 55 else 0.7 * sfreq / 2
    designs = [filters.butterworth(1.0, None, sfreq), filters.butterworth(1.0, min(40.0, 0.45 * sfreq), sfreq), filters.butterworth(None, split, sfreq)]
    spectrum_length = max(8, round(spectrum_seconds * sfreq))

    def one(row) -> dict:
        given = np.asarray(row.values_, float)
        x = np.nan_to_num(given)
        sample = row.start + np.arange(len(x)) if row.numbers is None else np.asarray(row.numbers)
        high, band = filters.zero_phase(designs[0], x), filters.zero_phase(designs[1], x)
        low = filters.zero_phase(designs[2], high)
        start = int(sample[0]) // length * length

        def placed(v: np.ndarray) -> np.ndarray:
            out = np.full(int(sample[-1]) + 1 - start, np.nan)
            out[sample - start] = v
            return out

        in_windows = [placed(v)[: (int(sample[-1]) + 1 - start) // length * length].reshape(-1, length) for v in (high, band)]
        full = np.isfinite(in_windows[0]).all(axis=1)
        high_windows, band_windows = (w[full] for w in in_windows)
        noise = _scaled_mad(low)
        found = {
            "recording": row.recording, "channel": row.channel, "n_samples": len(x), "missing": bool(np.isnan(given).any()), "amplitude": _spread(band), "slow": _spread(x - high),
            "hf_ratio": _scaled_mad(high - low) / noise if noise > 1e-12 else 0.0, "clipping_fraction": _clipped(x, sample), "whole_std": float(high.std()), "windows": start // length + np.flatnonzero(full),
            "high_std": high_windows.std(axis=1), "high_ptp": np.ptp(high_windows, axis=1) if len(high_windows) else np.zeros(0), "band_std": band_windows.std(axis=1),
            "power": _median_welch(placed(x), start, spectrum_length, sfreq) if spectra else None, "start": start, "band": placed(band),
        }
        return found

    def run(frames):
        for rows in frames:
            # A few channels at a time, as what is found has the length of the signal.
            for at in range(0, len(rows), 64):
                yield pd.DataFrame([one(row) for row in rows.iloc[at : at + 64].rename(columns={"values": "values_"}).itertuples(index=False)])

    kind = dict(samples.dtypes)["recording"]
    return blockwise.in_blocks(samples, None, None).drop("block", "coded").mapInPandas(run, f"recording {kind}, channel string, {_DESCRIBED}")


def windows_of(table: DataFrame, std: str, ptp: str | None = None) -> DataFrame:
    """described()'s windows as rows (recording, channel, window, std, ptp)."""
    zipped = F.explode(F.arrays_zip(F.col("windows").alias("w"), F.col(std).alias("s"), F.col(ptp or std).alias("p")))
    return table.select(*KEY, zipped.alias("x")).select(*KEY, F.col("x.w").alias("window"), F.col("x.s").alias("std"), F.col("x.p").alias("ptp"))


def spectrum_of(table: DataFrame, sfreq: float, spectrum_seconds: float = 4.0) -> DataFrame:
    """described()'s spectra as rows (recording, channel, freq, power)."""
    length = max(8, round(spectrum_seconds * sfreq))
    return table.select(*KEY, F.posexplode("power").alias("bin", "power")).select(*KEY, (F.col("bin") * F.lit(sfreq / length)).alias("freq"), "power")


def in_blocks_of(table: DataFrame, length: int) -> DataFrame:
    """described()'s band signals in blocks of windows: (recording, block, channel, at, x); ``at`` is where x begins in its block."""
    size = length * BLOCK_WINDOWS
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("band") - 1) / size)
    piece = lambda k: F.struct(
        k.alias("block"),
        F.greatest(F.col("start") - k * size, F.lit(0)).cast("int").alias("at"),
        F.slice("band", F.greatest(k * size - F.col("start"), F.lit(0)).cast("int") + 1, (F.lit(size) - F.greatest(F.col("start") - k * size, F.lit(0))).cast("int")).alias("x"),
    )
    return table.select(*KEY, F.explode(F.transform(F.sequence(first, last), piece)).alias("b")).select(*KEY, "b.*")


def _block(table: pa.Table, size: int) -> tuple[list[str], np.ndarray]:
    """Channels in order of name and a row of ``size`` values for each, NaN where there are none."""
    names = table["channel"].to_pylist()
    x = np.full((len(names), size), np.nan)
    for row, at, values in zip(x, table["at"].to_pylist(), table["x"].combine_chunks(), strict=True):
        v = values.values.to_numpy(zero_copy_only=False)
        row[at : at + len(v)] = v
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], x[order]


def block_correlations(blocks: DataFrame, length: int) -> DataFrame:
    """(recording, a, b, r) of each block: correlations of a pair in full windows; and with b null the largest |r| of a channel with another in each."""
    kind = dict(blocks.dtypes)["recording"]

    def run(key, table):
        names, x = _block(table, length * BLOCK_WINDOWS)
        x = x.reshape(len(names), BLOCK_WINDOWS, length)
        x = x - x.mean(axis=2, keepdims=True)
        size = np.sqrt((x * x).sum(axis=2))
        unit = np.divide(x, size[:, :, None], out=np.where(np.isfinite(x), 0.0, np.nan), where=size[:, :, None] > 0)
        r = np.einsum("iwt,jwt->ijw", unit, unit)
        a, b = np.triu_indices(len(names), 1)
        pairs = [(names[i], names[j], v[np.isfinite(v)]) for i, j, v in zip(a, b, r[a, b], strict=True)]
        others = np.abs(r)
        others[np.arange(len(names)), np.arange(len(names))] = np.nan
        best = np.where(np.isfinite(others), others, -1.0).max(axis=1)
        rows = pairs + [(c, None, v[v >= 0]) for c, v in zip(names, best, strict=True)]
        one = [key[0].as_py()] * len(rows)
        return pa.table({"recording": pa.array(one, table.schema.field("recording").type), "a": pa.array([p[0] for p in rows], pa.string()), "b": pa.array([p[1] for p in rows], pa.string()), "r": pa.array([p[2] for p in rows], pa.list_(pa.float64()))})

    return blocks.groupBy("recording", "block").applyInArrow(run, f"recording {kind}, a string, b string, r array<double>")


def poorly_correlated(correlations: DataFrame, least: float = 0.4) -> DataFrame:
    """Share of a channel's windows in which it correlates less than ``least`` with every other."""
    best = correlations.where("b is null").select("recording", F.col("a").alias("channel"), F.explode("r").alias("r"))
    return best.groupBy(*KEY).agg(F.avg((F.col("r") < least).cast("double")).alias("corr_bad_fraction"))


def _residual_moments(blocks: DataFrame, around: DataFrame, length: int) -> DataFrame:
    """Excess kurtosis of each channel's band signal less the mean of its neighbours', from sums over blocks."""
    kind = dict(blocks.dtypes)["recording"]
    lists = around.groupBy(*KEY).agg(F.collect_set("neighbour").alias("around"))
    sums = ["n", "s1", "s2", "s3", "s4"]

    def run(key, table):
        names, x = _block(table, length * BLOCK_WINDOWS)
        near = dict(zip(table["channel"].to_pylist(), table["around"].to_pylist(), strict=True))
        place, there = {c: i for i, c in enumerate(names)}, np.isfinite(x)
        filled = np.where(there, x, 0.0)
        out = []
        for i, c in enumerate(names):
            own = [place[o] for o in near[c] or [] if o in place]
            count = there[own].sum(axis=0)
            v = (filled[i] - np.divide(filled[own].sum(axis=0), count, out=np.zeros(len(count)), where=count > 0))[there[i]]
            out.append([float(len(v)), *(float((v**k).sum()) for k in (1, 2, 3, 4))])
        columns = dict(zip(sums, np.array(out).T, strict=True))
        return pa.table({"recording": pa.array([key[0].as_py()] * len(names), table.schema.field("recording").type), "channel": pa.array(names, pa.string()), **{k: pa.array(v) for k, v in columns.items()}})

    found = blocks.join(lists, KEY, "left").groupBy("recording", "block").applyInArrow(run, f"recording {kind}, channel string, n double, s1 double, s2 double, s3 double, s4 double")
    total = found.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in sums))
    m = F.col("s1") / F.col("n")
    second = F.col("s2") / F.col("n") - m * m
    fourth = (F.col("s4") - 4 * m * F.col("s3") + 6 * m * m * F.col("s2")) / F.col("n") - 3 * m * m * m * m
    kurtosis = F.when(second > 0, fourth / (second * second) - 3)
    n = F.col("n")
    return total.select(*KEY, F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurtosis + 6)).alias("local_kurtosis"))


def metrics(samples: DataFrame, sfreq: float, line: float | None = None, near: DataFrame | None = None, window: float = 1.0, flat: float = 0.5, ptp: float = 200.0) -> DataFrame:
    """A row of metrics for each channel. ``near`` (channel, neighbour) is the montage's; without one, a channel's
    neighbours are the four that it is most correlated with. Dead channels don't count as neighbours while a live one is there.

    Samples are shuffled by channel once; the band signals that come of it are compared in blocks of a recording, twice: for
    the correlations, and for what is left of each channel without its neighbours.
    """
    length = max(2, round(window * sfreq))
    table = kept(described(samples, sfreq, length))
    high, band = windows_of(table, "high_std", "high_ptp"), windows_of(table, "band_std")
    drift = 20 * F.log10(F.greatest(F.col("slow") / F.greatest("amplitude", F.lit(1e-9)), F.lit(1e-9)))
    level = table.select(*KEY, "n_samples", "amplitude", drift.alias("drift_db"), "hf_ratio", "clipping_fraction")
    spectrum = spectrum_of(table, sfreq)
    nyquist = sfreq / 2
    noise = (45.0, min(95.0, nyquist - 2)) if nyquist > 55 else (0.7 * nyquist, nyquist - 1)
    away = spectrum if not line else spectrum.where(F.abs(F.col("freq") - line) > 2)
    blocks = in_blocks_of(table, length)
    compared = kept(block_correlations(blocks, length))
    medians = compared.where("b is not null").select("recording", "a", "b", F.explode("r").alias("r")).groupBy("recording", "a", "b").agg(F.median(F.abs("r")).alias("value"))
    middle = kept(both_ways(medians).withColumnRenamed("value", "r"))
    # A channel shorter than a window is flat or not as a whole.
    whole = F.coalesce("flat_fraction", (F.col("whole_std") < flat).cast("double")).alias("flat_fraction")
    flats = kept(table.select(*KEY, "whole_std").join(windowing.flat_fraction(high, flat), KEY, "left").select(*KEY, whole))
    live = flats.where("flat_fraction < 0.5").select("recording", F.col("channel").alias("neighbour"), F.lit(True).alias("live"))
    if near is None:
        best = W.partitionBy(*KEY).orderBy(F.desc("r"), "other")
        around = middle.withColumn("p", F.row_number().over(best)).where("p <= 4").select(*KEY, F.col("other").alias("neighbour"))
    else:
        around = table.select(*KEY).join(near.select("channel", "neighbour"), "channel")
    around = around.join(live, ["recording", "neighbour"], "left").withColumn("any", F.max("live").over(W.partitionBy(*KEY)))
    around = kept(around.where("live or any is null").select(*KEY, "neighbour"))
    tables = [
        flats,
        poorly_correlated(compared),
        _median_neighbours(middle, around),
        spectral.snr_db(spectrum, line or 1e9, noise=noise),
        spectral.aperiodic(away).select(*KEY, "exponent"),
        alpha_peak(spectrum),
        windowing.bad_window_fraction(high, ptp),
        _residual_moments(blocks, around, length),
        windowing.amplitude_instability(band),
    ]
    if line and line < nyquist - 3:
        tables.append(spectral.line_noise_db(spectrum, line))
    joined = reduce(lambda a, b: a.join(b, KEY, "left"), tables, level)
    if "line_noise_db" not in joined.columns:
        joined = joined.withColumn("line_noise_db", F.lit(0.0))
    return _across(joined, sfreq)


def _median_neighbours(middle: DataFrame, around: DataFrame) -> DataFrame:
    sides = middle.join(around.withColumnRenamed("neighbour", "other"), [*KEY, "other"])
    best = sides.withColumn("p", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("r"), "other"))).where("p <= 2")
    return best.groupBy(*KEY).agg(F.avg("r").alias("neighbour_correlation"))


def alpha_peak(psd: DataFrame, low: float = 7.0, high: float = 14.0) -> DataFrame:
    """Where in the alpha band the power stands highest above a 1/f line through the bins around it, and by how many dB."""
    inside = F.col("freq").between(low, high)
    beside = (F.col("freq").between(2, 30)) & ~inside
    logs = psd.select(*KEY, "freq", F.log10("freq").alias("x"), F.log10(F.greatest("power", F.lit(1e-20))).alias("y")).where("freq > 0")
    line = logs.where(beside).groupBy(*KEY).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    above = logs.where(inside).join(line, KEY).withColumn("e", F.col("y") - F.col("s") * F.col("x") - F.col("i"))
    best = above.groupBy(*KEY).agg(F.max_by(F.struct("freq", "e"), F.struct("e", -F.col("freq"))).alias("b"))
    return best.select(*KEY, F.col("b.freq").alias("alpha_peak_hz"), (10 * F.col("b.e")).alias("alpha_peak_db"))


def _across(table: DataFrame, sfreq: float) -> DataFrame:
    """The metrics that compare a recording's live channels, of which there have to be three."""
    table = table.withColumn("alive", F.col("flat_fraction") < 0.5)
    live = table.where("alive").withColumn("log_amplitude", F.log10(F.greatest("amplitude", F.lit(1e-6))))
    live = robust_z(robust_z(live, ["recording"], "log_amplitude", "dz"), ["recording"], "hf_ratio", "hz")
    group = W.partitionBy("recording")
    live = live.withColumns({"three": F.count("*").over(group) >= 3, "drift_level": F.median("drift_db").over(group)})
    found = live.select(*KEY, F.when(F.col("three"), F.col("dz")).alias("dz"), F.when(F.col("three") & F.lit(sfreq > 40), F.col("hz")).alias("hz"), "drift_level")
    out = table.join(found, KEY, "left")
    zero = F.lit(0.0)
    out = out.withColumns({"deviation_z": F.coalesce("dz", zero), "hf_noise_z": F.coalesce("hz", zero), "relative_drift": F.col("drift_db") - F.coalesce("drift_level", zero)})
    return out.withColumn("abs_deviation", F.abs("deviation_z")).drop("dz", "hz", "drift_level")


def scored(table: DataFrame, ramps: dict = RAMPS) -> DataFrame:
    """Adds penalties (map), score, grade, reasons (names of penalties, largest first) and rank to a table of metrics."""
    size = {name: F.greatest(*(full * ramp(F.col(m), a, b) for m, a, b, full in rules), F.lit(0.0)) for name, rules in ramps.items()}
    size = {name: v if name in ALWAYS else F.when(F.col("alive"), v).otherwise(0.0) for name, v in size.items()}
    listed = F.array(*(F.struct(v.alias("size"), F.lit(name).alias("name")) for name, v in size.items()))
    table = table.withColumn("_p", F.filter(listed, lambda p: p["size"] > 0))
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["size"])
    exact = F.when(F.col("alive"), F.least(F.greatest(100.0 - total, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)
    reasons = F.transform(F.filter(F.reverse(F.array_sort("_p")), lambda p: p["size"] >= REASON), lambda p: p["name"])
    out = table.withColumns({"_score": exact, "penalties": F.map_from_entries(F.transform("_p", lambda p: F.struct(p["name"], F.round(p["size"], 1)))), "reasons": reasons})
    out = out.withColumns({"score": F.round("_score", 1), "grade": grade(F.col("_score"))}).drop("_p", "_score")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("recording").orderBy(F.desc("score"), "channel")).cast("long"))


def assess(samples: DataFrame, sfreq: float, line: float | None = None, near: DataFrame | None = None, **options) -> DataFrame:
    """metrics() and what scored() makes of them. Channels need about ten seconds; shorter ones give rough figures."""
    return scored(metrics(samples, sfreq, line, near, **options))


def quick(samples: DataFrame, length: int, flat: float, ptp: float) -> DataFrame:
    """A score that needs no filter: flat windows, windows of large range, deviation from the recording's other channels."""
    windows = windowing.window_table(samples, length)
    level = samples.groupBy(*KEY).agg(F.count("*").alias("n"), robust_std(F.col("value")).alias("amplitude"))
    table = level.join(windowing.flat_fraction(windows, flat), KEY, "left").join(windowing.bad_window_fraction(windows, ptp), KEY, "left")
    table = table.withColumns({"flat_fraction": F.coalesce("flat_fraction", F.lit(0.0)), "bad_window_fraction": F.coalesce("bad_window_fraction", F.lit(0.0))})
    table = robust_z(table.withColumn("_l", F.log10(F.greatest("amplitude", F.lit(1e-6)))), ["recording"], "_l", "deviation_z").drop("_l")
    table = table.withColumns({"alive": F.col("flat_fraction") < 0.5, "abs_deviation": F.abs("deviation_z")})
    return scored(table, {"flat": RAMPS["flat"], "amplitude": [("abs_deviation", 3, 8, 40)], "artifacts": RAMPS["artifacts"]})
