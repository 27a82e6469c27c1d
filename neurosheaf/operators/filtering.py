"""Filters of channels. Band filters and notches go over channels of any length in blocks (see blockwise); resampling and
envelopes take a channel as one group with a numpy kernel, so that it has to fit a task (an hour at 256 Hz takes 7 MB).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from . import blockwise
from .signals import KEY, Whole, made_of, remember


def _same(x: np.ndarray) -> np.ndarray:
    return x


def per_channel(samples: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], triggers: DataFrame | None = None, trigger_kernel: Callable[[np.ndarray], np.ndarray] = _same) -> DataFrame:
    """The kernel's signal in place of each channel's; samples are numbered from the channel's first one.

    Channels in ``triggers`` (recording, channel) hold codes: they are left as they are, or to a kernel of their own.
    """

    whole = blockwise.in_blocks(samples, triggers, None).withColumn("numbers", F.lit(None).cast("array<bigint>"))
    made = blockwise.changed(whole, lambda x, held: (trigger_kernel if held else kernel)(x), "coded")
    return remember(blockwise.from_blocks(made), Whole(made, False))


def _picked(samples: DataFrame, channels: list[str] | None, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` of some channels; the others as they are."""
    if channels is None and made_of(samples) is not None:
        return change(samples)
    samples = samples.select(*KEY, F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"))
    if channels is None:
        return change(samples)
    named = F.col("channel").isin(channels)
    return change(samples.where(named)).unionByName(samples.where(~named))


def band_filter(samples: DataFrame, low: float | None, high: float | None, sfreq: float, method: str = "iir", zero_phase: bool = True, channels: list[str] | None = None, triggers: DataFrame | None = None) -> DataFrame:
    """Butterworth (iir) or windowed-sinc (fir) filter of channels of any length, forwards and backwards or causal; see blockwise."""
    if method == "iir":
        sos = filters.butterworth(low, high, sfreq)
        return _picked(samples, channels, lambda s: blockwise.filtered(s, [sos], zero_phase, triggers))
    if method != "fir":
        raise ValueError("method is iir or fir")
    taps = filters.windowed_sinc(low, high, sfreq)
    return _picked(samples, channels, lambda s: blockwise.fir(s, taps, zero_phase, triggers))


def notch_filter(samples: DataFrame, frequency: float, sfreq: float, quality: float = 30.0, channels: list[str] | None = None, triggers: DataFrame | None = None) -> DataFrame:
    """Takes out a frequency and its harmonics below half the rate less 1 Hz."""
    stops = [filters.notch(f, sfreq, quality) for f in np.arange(frequency, sfreq / 2 - 1, frequency)]
    return _picked(samples, channels, lambda s: blockwise.filtered(s, stops, True, triggers))


def weighted_frame(samples: DataFrame, taps: list[float]) -> DataFrame:
    """A short FIR filter without leaving the JVM: a weighted frame of neighbours; beyond the ends are zeros."""
    from .signals import in_order

    half = len(taps) // 2
    shifted = sum(F.coalesce(F.lag("value", k - half).over(in_order()), F.lit(0.0)) * F.lit(float(t)) for k, t in enumerate(taps))
    return samples.select(*KEY, "sample", shifted.alias("value"))


def resample(samples: DataFrame, sfreq: float, to: float, channels: list[str] | None = None, triggers: DataFrame | None = None) -> DataFrame:
    """Channels at another rate, by a ratio with a denominator of at most 1000; trigger channels as resample_stim() does."""
    ratio = Fraction(to / sfreq).limit_denominator(1000)
    signal = lambda x: filters.resample(x, ratio.numerator, ratio.denominator)
    return _picked(samples, channels, lambda s: per_channel(s, signal, triggers, lambda x: resampled_codes(x, to / sfreq)))


def resampled_codes(codes: np.ndarray, ratio: float) -> np.ndarray:
    """resample_stim() of one channel; of codes that fall on one sample the largest stays."""
    out = np.zeros(math.ceil(len(codes) * ratio))
    starts = np.flatnonzero(np.diff(codes, prepend=np.nan) != 0)
    for start, end in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
        if codes[start] != 0:
            first = int(np.rint(start * ratio))
            place = slice(first, max(int(np.rint(end * ratio)), first + 1))
            out[place] = np.where(out[place] == 0, codes[start], np.maximum(out[place], codes[start]))
    return out


def resample_stim(samples: DataFrame, sfreq: float, to: float) -> DataFrame:
    """Trigger channels at another rate: each run of a code moves by its start, and lasts a sample at least."""
    from .windowing import runs

    ratio = float(to) / float(sfreq)
    found = runs(samples, F.col("value")).where("state <> 0")
    start = F.rint(F.col("start") * ratio).cast("long")
    end = F.greatest(F.rint((F.col("start") + F.col("length")) * ratio).cast("long"), start + 1)
    coded = found.select(*KEY, F.col("state").alias("code"), F.explode(F.sequence(start, end - 1)).alias("sample")).groupBy(*KEY, "sample").agg(F.max("code").alias("code"))
    n = samples.groupBy(*KEY).agg(F.ceil(F.count("*") * ratio).cast("long").alias("n"))
    every = n.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sample"))
    return every.join(coded, [*KEY, "sample"], "left").select(*KEY, "sample", F.coalesce("code", F.lit(0.0)).alias("value"))


def envelope(samples: DataFrame, low: float, high: float, sfreq: float, triggers: DataFrame | None = None) -> DataFrame:
    """The amplitude of a band: band-pass, then the modulus of the analytic signal; channels in ``triggers`` stay as they are."""
    sos = filters.butterworth(low, high, sfreq)
    return per_channel(samples, lambda x: np.abs(filters.analytic(filters.zero_phase(sos, x))), triggers)
