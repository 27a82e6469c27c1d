"""The table of channels (recording, channel, ch_index, ch_type, bad, x, y, z): choosing, types, bad marks, positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import montage, names
from .signals import KEY

#: Types of channels, and those that hold signals of the body.
TYPES = ("eeg", "eog", "ecg", "emg", "resp", "stim", "misc")
DATA = ("eeg", "eog", "ecg", "emg", "resp")


def described(samples: DataFrame) -> DataFrame:
    """The table made from the channels that samples have, in order of name: types by name, none bad, no positions."""
    # A recording's names are listed and exploded: what is asked of a name later can't be pushed from here down to the samples.
    names_of = samples.select(*KEY).distinct().groupBy("recording").agg(F.array_sort(F.collect_list("channel")).alias("names"))
    found = names_of.select("recording", F.posexplode("names").alias("ch_index", "channel"))
    nothing = F.lit(None).cast("double")
    return found.select(*KEY, "ch_index", names.channel_type(names.clean_channel_name(F.col("channel"))).alias("ch_type"), F.lit(False).alias("bad"), nothing.alias("x"), nothing.alias("y"), nothing.alias("z"))


def pick(channels: DataFrame, what: str | int | list | None = None, exclude_bad: bool = False) -> DataFrame:
    """Channels by what is asked for: None or all; data (signals of the body); good (EEG that isn't bad); a type; a name, exact,
    in any case or cleaned; a place (negative from the end); or a list of these. Recordings that have none lack rows."""
    size = F.count("*").over(W.partitionBy("recording"))

    def wanted(x):
        if x is None or x == "all":
            return F.lit(True)
        if isinstance(x, int):
            return F.col("ch_index") == (F.lit(x) if x >= 0 else F.col("_size") + x)
        exact = F.col("channel") == x
        if x == "data":
            return exact | F.col("ch_type").isin(*DATA)
        if x == "good":
            return exact | ((F.col("ch_type") == "eeg") & ~F.col("bad"))
        if x in TYPES:
            return exact | (F.col("ch_type") == x)
        return exact | (F.lower("channel") == x.lower()) | (names.clean_channel_name(F.col("channel")) == names.clean_channel_name(F.lit(x)))

    chosen = F.lit(False)
    for x in what if isinstance(what, list) else [what]:
        chosen = chosen | wanted(x)
    found = channels.withColumn("_size", size).where(chosen).drop("_size")
    return found.where(~F.col("bad")) if exclude_bad else found


def unique_names(channels: DataFrame, name: Column) -> DataFrame:
    """Adds _new: ``name``, and for the second, third, ... channel of a recording with one name that name and -1, -2, ...
    by place; a name with a number that another channel has already gets the next number."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ch_index", kind="stable")
        taken, out = set(rows._new), []
        for i, wanted in enumerate(rows._new):
            if wanted in out:
                number = next(k for k in range(1, len(rows) + i + 2) if f"{wanted}-{k}" not in taken and f"{wanted}-{k}" not in out)
                wanted = f"{wanted}-{number}"
            out.append(wanted)
        return rows.assign(_new=out)

    named = channels.withColumn("_new", name)
    return named.groupBy("recording").applyInPandas(run, named.schema)


def source_density(channels: DataFrame) -> DataFrame:
    """(recording, output, channel, weight) of the current source density over good EEG channels with positions; the others stay as they are."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        good = rows[rows.x.notna() & (rows.ch_type == "eeg") & ~rows.bad]
        own = rows if len(good) < 4 else rows[~rows.channel.isin(good.channel)]
        out = [(c, c, 1.0) for c in own.channel]
        if len(good) >= 4:
            w = montage.density_weights(good[["x", "y", "z"]].to_numpy(float))
            out += [(o, i, float(v)) for o, row in zip(good.channel, w, strict=True) for i, v in zip(good.channel, row, strict=True)]
        return pd.DataFrame([(rows.recording.iloc[0], *o) for o in out], columns=["recording", "output", "channel", "weight"])

    return channels.groupBy("recording").applyInPandas(run, f"recording {dict(channels.dtypes)['recording']}, output string, channel string, weight double")


def type_counts(channels: DataFrame) -> DataFrame:
    return channels.groupBy("recording", "ch_type").agg(F.count("*").alias("n"))


def set_types(channels: DataFrame, kinds: dict[str, str]) -> DataFrame:
    wrong = set(kinds.values()) - set(TYPES)
    if wrong:
        raise ValueError(f"unknown types: {sorted(wrong)}")
    table = F.create_map(*(F.lit(v) for pair in kinds.items() for v in pair))
    return channels.withColumn("ch_type", F.coalesce(F.try_element_at(table, F.col("channel")), F.col("ch_type")))


def set_bads(channels: DataFrame, bad: list[str] | DataFrame, add: bool = False) -> DataFrame:
    """Marks channels bad: names in all recordings, or rows (recording, channel); ``add`` keeps the marks there are."""
    if isinstance(bad, list):
        marked = F.col("channel").isin(bad)
        return channels.withColumn("bad", marked | F.col("bad") if add else marked)
    rows = bad.select(*KEY).distinct().withColumn("_bad", F.lit(True))
    marked = F.coalesce("_bad", F.lit(False))
    return channels.join(rows, KEY, "left").withColumn("bad", marked | F.col("bad") if add else marked).drop("_bad")


def bipolar_table(channels: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The table of channels of spatial.bipolar(): EEG, halfway between the two of a pair, and bad if one of them is; trigger channels as they are, last."""
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(c).alias("c")) for i, (a, c) in enumerate(pairs)))
    side = lambda name: channels.select("recording", F.col("channel").alias(name), F.struct("x", "y", "z", "bad").alias(f"{name}_row"))
    both = channels.select("recording").distinct().select("recording", F.explode(listed).alias("p")).select("recording", "p.*").join(side("a"), ["recording", "a"]).join(side("c"), ["recording", "c"])
    made = {"channel": F.concat_ws("-", "a", "c"), "ch_index": F.col("i").cast(dict(channels.dtypes)["ch_index"]), "ch_type": F.lit("eeg"), "bad": F.col("a_row.bad") | F.col("c_row.bad")}
    made |= {x: (F.col(f"a_row.{x}") + F.col(f"c_row.{x}")) / 2 for x in "xyz"}
    kinds = dict(channels.dtypes)
    found = both.select(*(c if c == "recording" else made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in channels.columns))
    codes = channels.where("ch_type = 'stim'").withColumn("ch_index", (F.col("ch_index") + len(pairs)).cast(kinds["ch_index"]))
    return found.unionByName(codes)


def standard_montage(spark) -> DataFrame:
    """(name, mx, my, mz) of the 10-10 layout; some ninety rows."""
    return spark.createDataFrame([(n, *map(float, p)) for n, p in montage.standard_positions().items()], "name string, mx double, my double, mz double")


def set_montage(channels: DataFrame, layout: DataFrame | None = None, overwrite: bool = True) -> DataFrame:
    """Positions by cleaned names; channels that the layout lacks keep what they have."""
    layout = standard_montage(channels.sparkSession) if layout is None else layout
    joined = channels.withColumn("_name", names.clean_channel_name(F.col("channel"))).join(F.broadcast(layout), F.col("_name") == F.col("name"), "left")
    first = lambda a, b: F.coalesce(a, b) if overwrite else F.coalesce(b, a)
    return joined.withColumns({c: first(F.col(f"m{c}"), F.col(c)) for c in "xyz"}).drop("_name", "name", "mx", "my", "mz")


def interpolation(channels: DataFrame, fewest: int = 4) -> DataFrame:
    """(recording, output, channel, weight): good channels as they are, bad EEG channels with a position from the good ones with one.

    Recordings with fewer than ``fewest`` good ones keep their channels as they are.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        placed = rows.x.notna() & (rows.ch_type == "eeg")
        good, bad = rows[placed & ~rows.bad], rows[placed & rows.bad]
        made = len(good) >= fewest and len(bad) > 0
        own = rows[~rows.channel.isin(bad.channel)] if made else rows
        out = pd.DataFrame({"output": own.channel, "channel": own.channel, "weight": 1.0})
        if made:
            w = montage.spline_weights(good[["x", "y", "z"]].to_numpy(float), bad[["x", "y", "z"]].to_numpy(float))
            grid = [(o, i, float(v)) for o, row in zip(bad.channel, w, strict=True) for i, v in zip(good.channel, row, strict=True)]
            out = pd.concat([out, pd.DataFrame(grid, columns=["output", "channel", "weight"])])
        out.insert(0, "recording", rows.recording.iloc[0])
        return out

    return channels.groupBy("recording").applyInPandas(run, f"recording {dict(channels.dtypes)['recording']}, output string, channel string, weight double")


def laplacian(channels: DataFrame, k: int = 4) -> DataFrame:
    """(recording, output, channel, weight) of the Hjorth Laplacian over good EEG channels with positions; the others stay as they are.

    A recording with fewer than k + 1 such channels stays as it is.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        good = rows[rows.x.notna() & (rows.ch_type == "eeg") & ~rows.bad].sort_values("channel")
        out = [(c, c, 1.0) for c in rows.channel]
        if len(good) > k:
            p = good[["x", "y", "z"]].to_numpy(float)
            angle = np.round(np.arccos(np.clip(p @ p.T, -1, 1)), 9)
            np.fill_diagonal(angle, np.inf)
            listed = good.channel.to_list()
            out += [(c, listed[j], -1.0 / k) for i, c in enumerate(listed) for j in np.argsort(angle[i], kind="stable")[:k]]
        return pd.DataFrame([(rows.recording.iloc[0], *o) for o in out], columns=["recording", "output", "channel", "weight"])

    return channels.groupBy("recording").applyInPandas(run, f"recording {dict(channels.dtypes)['recording']}, output string, channel string, weight double")


def apply_weights(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """Each recording's channels as its own weights make them."""
    parts = samples.join(weights, KEY).select("recording", F.col("output").alias("channel"), "sample", (F.col("value") * F.col("weight")).alias("value"))
    return parts.groupBy(*KEY, "sample").agg(F.sum("value").alias("value"))
