"""Connectivity between channels: rows (recording, a, b, value) with a < b."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import filters
from . import blockwise
from .filtering import per_channel
from .signals import Whole, made_of, transformed

PAIR = ["recording", "a", "b"]


def _matrix(table: pa.Table, column: str = "value") -> tuple[list[str], np.ndarray]:
    """Channels in order of name, and a row of values for each at the samples of a block; NaN where there is none."""
    if "places" in table.column_names:
        names = table["channel"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        x = blockwise.piece_matrix(table["at"].to_pylist(), table["places"].combine_chunks(), table["x"].combine_chunks())
        return [names[i] for i in order], x[order]
    coded = table["channel"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = np.argsort(np.array(names, object))
    place = np.empty(len(names), int)
    place[order] = np.arange(len(names))
    _, at = np.unique(table["sample"].to_numpy(), return_inverse=True)
    x = np.full((len(names), at.max() + 1), np.nan)
    x[place[coded.indices.to_numpy()], at] = table[column].to_numpy()
    return [names[i] for i in order], x


def in_blocks(samples: DataFrame, size: int, kernel: Callable, columns: str, block: str = "block") -> DataFrame:
    """(recording, block, a, b, columns) for each pair of channels in blocks of ``size`` samples.

    A block of a recording with all its channels is one group; the kernel takes its matrix (channels, samples) and the
    rows a and b of the pairs, and gives arrays. So samples are shuffled once, and what is made is a row a pair and
    block, where a join of channels with channels would make one a pair and sample.
    """
    kind = dict(samples.dtypes)["recording"]

    def run(key, table):
        names, x = _matrix(table)
        a, b = np.triu_indices(len(names), 1)
        out = {block: pa.array(np.full(len(a), key[1].as_py(), np.int64)), "a": pa.array([names[i] for i in a], pa.string()), "b": pa.array([names[i] for i in b], pa.string())}
        made = kernel(x, a, b) if len(a) else {c.split()[0]: np.zeros(0) for c in columns.split(", ")}
        return pa.table({"recording": pa.array([key[0].as_py()] * len(a), table.schema.field("recording").type), **out, **{k: pa.array(np.asarray(v, float)) for k, v in made.items()}})

    own = made_of(samples)
    if isinstance(own, Whole):  # arrays are cut, not samples grouped
        placed = blockwise.pieces(own.blocks, size, block)
    else:
        placed = samples.select("recording", F.floor(F.col("sample") / size).cast("long").alias(block), "channel", "sample", F.col("value").cast("double").alias("value"))
    return placed.groupBy("recording", block).applyInArrow(run, f"recording {kind}, `{block}` long, a string, b string, {columns}")


def _moments(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, means and central products of pairs over the samples that both have."""
    there = np.isfinite(x)
    centre = np.array([row[m].mean() if m.any() else 0.0 for row, m in zip(x, there, strict=True)])
    x, m = np.where(there, x - centre[:, None], 0.0), there.astype(float)
    n, sums, squares, products = m @ m.T, x @ m.T, (x * x) @ m.T, x @ x.T
    count = np.maximum(n, 1)
    ma, mb = sums[a, b] / count[a, b], sums[b, a] / count[a, b]
    own = {"n": n[a, b], "ma": centre[a] + ma, "mb": centre[b] + mb}
    return own | {"aa": squares[a, b] - n[a, b] * ma * ma, "bb": squares[b, a] - n[a, b] * mb * mb, "ab": products[a, b] - n[a, b] * ma * mb}


_MOMENTS = "n double, ma double, mb double, aa double, bb double, ab double"


def _r(aa: Column, bb: Column, ab: Column) -> Column:
    """Pearson's r; without variance, up to rounding: 0."""
    return F.when((aa > 0) & (bb > 0), ab / F.sqrt(aa * bb)).otherwise(0.0)


def correlation(samples: DataFrame, size: int = 4096) -> DataFrame:
    """Pearson's correlation over all samples that both channels have; without variance: 0."""
    blocks = in_blocks(samples, size, _moments, _MOMENTS).where("n > 0").groupBy(*PAIR).agg(F.collect_list(F.struct("n", "ma", "mb", "aa", "bb", "ab")).alias("s"))

    def merged(s, x):  # moments of two sets put together
        n, da, db = s["n"] + x["n"], x["ma"] - s["ma"], x["mb"] - s["mb"]
        w = s["n"] * x["n"] / n
        return F.struct(n.alias("n"), (s["ma"] + da * x["n"] / n).alias("ma"), (s["mb"] + db * x["n"] / n).alias("mb"), (s["aa"] + x["aa"] + w * da * da).alias("aa"), (s["bb"] + x["bb"] + w * db * db).alias("bb"), (s["ab"] + x["ab"] + w * da * db).alias("ab"))

    total = blocks.withColumn("t", F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.col("s")[0], merged))
    return total.select(*PAIR, _r(F.col("t.aa"), F.col("t.bb"), F.col("t.ab")).alias("value"))


def window_correlations(samples: DataFrame, length: int) -> DataFrame:
    """(recording, window, a, b, value): correlations in full tumbling windows; without variance: 0."""
    found = in_blocks(samples, length, _moments, _MOMENTS, "window").where(F.col("n") == length)
    return found.select("recording", "window", "a", "b", _r(F.col("aa"), F.col("bb"), F.col("ab")).alias("value"))


def both_ways(pairs: DataFrame, *keys: str) -> DataFrame:
    """(recording, keys, channel, other, value) with each pair from both sides."""
    one = pairs.select("recording", *keys, F.col("a").alias("channel"), F.col("b").alias("other"), "value")
    return one.unionByName(pairs.select("recording", *keys, F.col("b").alias("channel"), F.col("a").alias("other"), "value"))


def max_correlation(windows: DataFrame) -> DataFrame:
    """Largest |r| of each channel with another, in each window."""
    return both_ways(windows, "window").groupBy("recording", "channel", "window").agg(F.max(F.abs("value")).alias("max_correlation"))


def neighbour_correlation(windows: DataFrame, near: DataFrame, best: int = 2) -> DataFrame:
    """Mean over a channel's ``best`` neighbours of the median |r| over windows."""
    sides = both_ways(windows, "window").join(near.select("channel", F.col("neighbour").alias("other")), ["channel", "other"])
    middle = sides.groupBy("recording", "channel", "other").agg(F.median(F.abs("value")).alias("r"))
    ranked = middle.withColumn("place", F.row_number().over(W.partitionBy("recording", "channel").orderBy(F.desc("r"), "other"))).where(F.col("place") <= best)
    return ranked.groupBy("recording", "channel").agg(F.avg("r").alias("neighbour_correlation"))


def strongest(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` pairs of largest |value| of each recording, ties by name."""
    order = W.partitionBy("recording").orderBy(F.desc(F.abs("value")), "a", "b")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def node_strength(pairs: DataFrame) -> DataFrame:
    """Mean |value| of each channel with the others."""
    return both_ways(pairs).groupBy("recording", "channel").agg(F.avg(F.abs("value")).alias("node_strength"))


#: Segments of a recording that are one group when cross-spectra are summed.
SEGMENTS = 64


def _spectra(samples: DataFrame, length: int, step: int, bins: np.ndarray) -> DataFrame:
    """(recording, channel, segment, z): real and imaginary parts of the wanted bins of Hann-windowed segments, one after the other."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)

    def spectra(x: np.ndarray) -> np.ndarray:
        z = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)[:, bins]
        return np.concatenate([z.real, z.imag], axis=1)

    return transformed(samples, length, step, spectra, "z")


#: What _cross() sums.
_SUMS = ("re", "im", "aa", "bb", "sign", "size", "n")


def _cross(rows: pa.Table, n: int) -> dict:
    """Sums over segments of what the measures need, for each pair and bin."""
    names, ci = np.unique(np.array(rows["channel"].to_pylist(), object), return_inverse=True)
    seg, si = np.unique(rows["segment"].to_numpy(), return_inverse=True)
    z = np.zeros((len(names), len(seg), n), complex)
    there = np.zeros((len(names), len(seg), 1))
    parts = rows["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * n)
    z[ci, si], there[ci, si] = parts[:, :n] + 1j * parts[:, n:], 1.0
    found = []
    for i in range(len(names)):  # one channel with all after it
        both = there[i] * there[i + 1 :]
        s = z[i] * z[i + 1 :].conj() * both
        power = (np.abs(z[i]) ** 2 * both).sum(axis=1), (np.abs(z[i + 1 :]) ** 2 * both).sum(axis=1)
        sums = [s.real.sum(axis=1), s.imag.sum(axis=1), *power, np.sign(s.imag).sum(axis=1), np.abs(s.imag).sum(axis=1), np.broadcast_to(both.sum(axis=1), s.shape[::2])]
        found.append(np.stack(sums).reshape(len(sums), -1))
    a, b = np.triu_indices(len(names), 1)
    return {"a": np.repeat(names[a], n), "b": np.repeat(names[b], n), "bin": np.tile(np.arange(n), len(a)), **dict(zip(_SUMS, np.concatenate(found, axis=1), strict=True))}


def spectral(samples: DataFrame, sfreq: float, low: float, high: float, method: str = "coherence", seconds: float = 2.0) -> DataFrame:
    """coherence, imcoh, pli or wpli: from cross-spectra summed over half-overlapping segments, then averaged over the band's bins.

    Only the band's bins leave a segment; cross-spectra are summed over many segments before they are shuffled.
    """
    length = max(8, round(seconds * sfreq))
    freqs = np.arange(length // 2 + 1) * sfreq / length
    bins = np.flatnonzero((freqs >= low) & (freqs <= high))
    kind = dict(samples.dtypes)["recording"]

    def run(key, rows):
        made = {k: pa.array(v, pa.string() if k in ("a", "b") else pa.int64() if k == "bin" else pa.float64()) for k, v in _cross(rows, len(bins)).items()}
        return pa.table({"recording": pa.array([key[0].as_py()] * len(made["a"]), rows.schema.field("recording").type), **made})

    grouped = _spectra(samples, length, round(length / 2), bins).withColumn("chunk", F.floor(F.col("segment") / SEGMENTS))
    parts = grouped.groupBy("recording", "chunk").applyInArrow(run, f"recording {kind}, a string, b string, bin long, re double, im double, aa double, bb double, sign double, size double, n double")
    sums = parts.groupBy(*PAIR, "bin").agg(*(F.sum(c).alias(c) for c in _SUMS))
    power = F.col("aa") * F.col("bb")
    value = {
        "coherence": F.when(power > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power),
        "imcoh": F.when(power > 0, F.abs(F.col("im") / F.sqrt(power))),
        "pli": F.when(F.col("n") > 0, F.abs(F.col("sign") / F.col("n"))),
        "wpli": F.when(F.col("size") > 0, F.abs("im") / F.col("size")),
    }[method]
    return sums.groupBy(*PAIR).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("value"))


def _phases(samples: DataFrame, low: float, high: float, sfreq: float) -> DataFrame:
    sos = filters.butterworth(low, high, sfreq)
    return per_channel(samples, lambda x: np.angle(filters.analytic(filters.zero_phase(sos, x))))


def _locking(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    unit = np.where(np.isfinite(x), np.exp(1j * np.nan_to_num(x)), 0)
    sums, there = unit @ unit.conj().T, np.isfinite(x).astype(float)
    return {"re": sums.real[a, b], "im": sums.imag[a, b], "n": (there @ there.T)[a, b]}


def phase_locking(samples: DataFrame, sfreq: float, low: float, high: float, size: int = 4096) -> DataFrame:
    """Length of the mean unit vector of phase differences in a band."""
    parts = in_blocks(_phases(samples, low, high, sfreq), size, _locking, "re double, im double, n double")
    return parts.groupBy(*PAIR).agg((F.hypot(F.sum("re"), F.sum("im")) / F.sum("n")).alias("value"))


def envelope_correlation(samples: DataFrame, sfreq: float, low: float, high: float) -> DataFrame:
    """Correlation of the band's amplitudes."""
    from .filtering import envelope

    return correlation(envelope(samples, low, high, sfreq))
