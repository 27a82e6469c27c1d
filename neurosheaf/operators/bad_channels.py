"""Bad channels by the criteria of the PREP pipeline, and by prediction from random subsets (RANSAC)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import montage
from ..session import kept
from . import quality, windowing
from .signals import KEY
from .statistics import robust_z

METHODS = ("nan", "flat", "deviation", "dropout", "correlation", "hf_noise", "ransac")


def _z(table: DataFrame, value: str, out: str) -> DataFrame:
    """Robust z among usable channels where there are three; else 0."""
    usable = table.where("usable")
    enough = usable.groupBy("recording").agg((F.count("*") >= 3).alias("_enough"))
    found = robust_z(usable, ["recording"], value, out).join(enough, "recording").where("_enough").select(*KEY, out)
    return table.join(found, KEY, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def find_bad_channels(samples: DataFrame, sfreq: float, positions: DataFrame | None = None, flat: float = 0.5, seed: int = 0, ransac_channels: int = 32, ransac_windows: int = 120) -> DataFrame:
    """A row a channel with a boolean for each of METHODS, bad (any of them) and what they were judged by.

    Prediction by RANSAC runs in recordings for which ``positions`` (recording, channel, x, y, z) has ``ransac_channels``
    channels, and eight of them that nothing else flags; ``ransac_windows`` as in ransac().
    """
    length = max(2, round(sfreq))
    found = kept(quality.described(samples, sfreq, length, spectra=False))
    table = found.select(*KEY, "amplitude", "hf_ratio", "missing")
    table = table.withColumns({"nan": F.col("missing"), "flat": F.col("amplitude") < flat}).withColumn("usable", ~F.col("nan") & ~F.col("flat"))
    table = _z(table, "amplitude", "deviation_z")
    windows = quality.windows_of(found, "band_std")
    table = table.join(windowing.flat_fraction(windows, flat * 0.2).withColumnRenamed("flat_fraction", "dropout_fraction"), KEY, "left")
    good = found.join(table.where("usable").select(*KEY), KEY, "left_semi")
    poor = quality.poorly_correlated(quality.block_correlations(quality.in_blocks_of(good, length), length)).withColumnRenamed("corr_bad_fraction", "correlation_bad_fraction")
    table = _z(table.join(poor, KEY, "left"), "hf_ratio", "hf_noise_z")
    table = table.withColumns(
        {
            "deviation": F.abs("deviation_z") > 5,
            "dropout": (F.coalesce("dropout_fraction", F.lit(0.0)) > 0.01) & ~F.col("flat"),
            "correlation": F.coalesce("correlation_bad_fraction", F.lit(0.0)) > 0.05,
            "hf_noise": (F.col("hf_noise_z") > 5) & F.lit(sfreq > 40),
        }
    )
    any_of = lambda names: F.array_max(F.array(*(F.coalesce(n, F.lit(False)) for n in names)))
    table = table.withColumn("flagged", any_of(METHODS[:-1]))
    if positions is not None:
        table = kept(table)
        placed = positions.where("x is not null").select(*KEY, "x", "y", "z")
        enough = placed.groupBy("recording").agg(F.count("*").alias("n")).where(F.col("n") >= ransac_channels).select("recording")
        band = found.select(*KEY, "start", F.posexplode("band").alias("place", "value")).where("not isnan(value)")
        band = band.select(*KEY, (F.col("start") + F.col("place")).alias("sample"), "value")
        fraction = ransac(band, table.where("not flagged").select(*KEY), placed.join(enough, "recording", "left_semi"), sfreq, seed, windows=ransac_windows)
        table = table.join(fraction, KEY, "left")
    else:
        table = table.withColumn("ransac_bad_fraction", F.lit(None).cast("double"))
    table = table.withColumn("ransac", (F.coalesce("ransac_bad_fraction", F.lit(0.0)) > 0.4) & ~F.col("flagged"))
    reasons = F.filter(F.array(*(F.when(F.col(m), F.lit(m)) for m in METHODS)), lambda x: x.isNotNull())
    return table.withColumns({"bad": F.col("flagged") | F.col("ransac"), "reasons": reasons}).drop("missing", "hf_ratio", "flagged", "usable")


@lru_cache(8)
def _models(members: tuple[str, ...], positions: tuple, seed: int, draws: int, subset: float) -> list[tuple[list[str], np.ndarray]]:
    """Random subsets of the members, and the weights by which they predict all channels."""
    rng, at = np.random.default_rng(seed), dict(positions)
    n = max(4, math.ceil(subset * len(members)))
    chosen = [[members[i] for i in rng.choice(len(members), n, replace=False)] for _ in range(draws)]
    return [(c, montage.spline_weights(np.array([at[x] for x in c]), np.array(list(at.values())))) for c in chosen]


def ransac(samples: DataFrame, pool: DataFrame, positions: DataFrame, sfreq: float, seed: int = 0, draws: int = 50, subset: float = 0.25, least: float = 0.75, seconds: float = 5.0, windows: int = 120) -> DataFrame:
    """Share of windows in which a channel correlates less than ``least`` with what random subsets of the pool predict.

    ``positions`` (recording, channel, x, y, z) says which channels are looked at. Each window of a recording is one group:
    all its channels for ``seconds``. At most ``windows`` windows, evenly spaced over the recording, are looked at; that
    bounds the work of this one criterion.
    """
    length = round(seconds * sfreq)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = {p["channel"]: (p["x"], p["y"], p["z"]) for p in rows.places.iloc[0]}
        names, order = list(at), {c: i for i, c in enumerate(at)}
        x = np.zeros((len(names), length))
        x[rows.channel.map(order).to_numpy(), (rows["sample"] % length).to_numpy()] = np.nan_to_num(rows.value.to_numpy(float))
        own = tuple(c for c in names if c in set(rows.members.iloc[0]))
        r = np.zeros(len(names))
        if len(own) >= 8:
            guess = np.median(np.stack([w @ x[[order[c] for c in chosen]] for chosen, w in _models(own, tuple(at.items()), seed, draws, subset)]), axis=0)
            a, b = x - x.mean(axis=1, keepdims=True), guess - guess.mean(axis=1, keepdims=True)
            size = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
            r = np.divide((a * b).sum(axis=1), size, out=r, where=size > 0)
        else:
            r += 1.0
        return pd.DataFrame({"recording": rows.recording.iloc[0], "channel": names, "poor": (r < least).astype(float)})

    places = positions.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("channel", "x", "y", "z"))).alias("places"))
    members = pool.groupBy("recording").agg(F.sort_array(F.collect_list("channel")).alias("members"))
    cut = samples.join(positions.select(*KEY), KEY, "left_semi").withColumn("window", F.floor(F.col("sample") / length))
    count = cut.groupBy("recording").agg(F.floor((F.max("sample") + 1) / length).alias("n"))
    looked_at = F.least(F.col("n"), F.lit(windows))
    spaced = F.transform(F.sequence(F.lit(0), looked_at - 1), lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(looked_at - 1, F.lit(1))))
    chosen = count.where("n > 0").select("recording", F.explode(spaced).alias("window")).distinct()
    ready = cut.join(chosen, ["recording", "window"]).join(members.join(places, "recording"), "recording")
    kind = dict(samples.dtypes)["recording"]
    found = ready.groupBy("recording", "window").applyInPandas(run, f"recording {kind}, channel string, poor double")
    return found.groupBy(*KEY).agg(F.avg("poor").alias("ransac_bad_fraction"))
