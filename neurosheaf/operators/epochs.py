"""Epochs: stretches of samples around events, and what is averaged over them.

An epoch's samples are rows (recording, epoch, condition, channel, time, value); time is in samples from
the event. The epoch's end is included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .annotations import by_block
from .signals import Wide, made_of, melt

EPOCH = ["recording", "epoch"]


def fixed_length_events(lengths: DataFrame, sfreq: float, duration: float, step: float | None = None, code: int = 1) -> DataFrame:
    """(recording, sample, code): starts of windows of ``duration`` seconds, every ``step``, that end inside the recording."""
    step = duration if step is None else step
    last = F.floor((F.col("n_samples") / float(sfreq) - float(duration) + 1e-9) / float(step))
    starts = F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.rint(i * float(step) * float(sfreq)).cast("long")))
    return lengths.select("recording", F.explode(starts).alias("sample"), F.lit(code).cast("long").alias("code"))


def find_events(annotations: DataFrame, stim: DataFrame, sfreq: float, codes: DataFrame | None = None) -> DataFrame:
    """(recording, sample, previous, code): from annotations that don't mark bad data where a recording has any, else from its trigger line."""
    from .annotations import drop_bad, event_codes, to_events
    from .windowing import stim_events

    told = drop_bad(annotations)
    own = to_events(told, event_codes(told) if codes is None else codes, sfreq).drop("description")
    rest = stim_events(stim).join(own.select("recording").distinct(), "recording", "left_anti").drop("channel")
    return own.unionByName(rest.select(own.columns))


def from_arrays(table: DataFrame, first: int = 0) -> DataFrame:
    """Epochs from rows (recording, epoch, condition, channel, values); the first value has time ``first``."""
    return table.select("recording", "epoch", "condition", "channel", F.posexplode("values").alias("time", "value")).withColumn("time", F.col("time") + first)


def place(events: DataFrame, lengths: DataFrame, tmin: float, tmax: float, sfreq: float, spans: DataFrame | None = None, size: int = 4096) -> DataFrame:
    """Events with epoch (numbered by sample), start, end (exclusive) and dropped: OUT_OF_BOUNDS before BAD_ANNOTATION, else null."""
    a, b = F.rint(F.lit(float(tmin)) * float(sfreq)).cast("long"), F.rint(F.lit(float(tmax)) * float(sfreq)).cast("long") + 1
    numbered = events.join(lengths, "recording").withColumn("epoch", F.row_number().over(W.partitionBy("recording").orderBy("sample", "code")) - 1)
    placed = numbered.withColumns({"start": F.col("sample") + a, "end": F.col("sample") + b})
    outside = (F.col("start") < 0) | (F.col("end") > F.col("n_samples"))
    if spans is None:
        return placed.withColumn("dropped", F.when(outside, "OUT_OF_BOUNDS"))
    touched = by_block(placed.where(~outside), size).select(*EPOCH, "block", "start", "end")
    bad = by_block(spans, size).select("recording", "block", F.col("start").alias("bad_start"), F.col("end").alias("bad_end"))
    hit = touched.join(bad, ["recording", "block"]).where("bad_start < end and bad_end > start").select(*EPOCH, F.lit(True).alias("bad")).distinct()
    return placed.join(hit, EPOCH, "left").withColumn("dropped", F.when(outside, "OUT_OF_BOUNDS").when(F.col("bad"), "BAD_ANNOTATION")).drop("bad")


def cut(samples: DataFrame, placed: DataFrame, size: int = 4096) -> DataFrame:
    """Samples of the epochs that aren't dropped: events meet the blocks of samples that they touch."""
    kept = by_block(placed.where("dropped is null"), size).select("recording", "block", "epoch", F.col("sample").alias("event"), "code", "start", "end")
    own = made_of(samples)
    if isinstance(own, Wide):
        return _cut_rows(own, kept, size)
    blocks = samples.withColumn("block", F.floor(F.col("sample") / size))
    found = blocks.join(kept, ["recording", "block"]).where("sample >= start and sample < end")
    return found.select("recording", "epoch", F.col("code").alias("condition"), "channel", (F.col("sample") - F.col("event")).alias("time"), "value")


def _cut_rows(own: Wide, kept: DataFrame, size: int) -> DataFrame:
    """cut() of rows with a column a channel. Each row gets the events of its block by a window over both, which Spark needn't shuffle
    where rows are dealt out by recording, as it has to for a join by block; nor then what is made of the epochs of a recording."""
    kind = dict(own.rows.dtypes)["recording"]
    told = kept.select(F.col("recording").cast(kind).alias("recording"), "block", F.struct("epoch", "event", "code", "start", "end").alias("_event")).repartition("recording")
    values = [F.col(c).cast("double").alias(c) for c in own.channels]
    rows = own.rows.select("recording", F.floor(F.col("sample") / size).alias("block"), "sample", *values)
    both = rows.unionByName(told, allowMissingColumns=True)
    met = both.withColumn("_event", F.collect_list("_event").over(W.partitionBy("recording", "block"))).where("sample is not null")
    found = met.withColumn("_event", F.explode("_event")).where("sample >= _event.start and sample < _event.end")
    time = (F.col("sample") - F.col("_event.event")).alias("time")
    return melt(found.select("recording", "_event.epoch", F.col("_event.code").alias("condition"), time, *own.channels), own.channels, ("recording", "epoch", "condition", "time"))


def baseline(epochs: DataFrame, first: int, last: int) -> DataFrame:
    """Values minus the epoch's mean over times from ``first`` to ``last``, both included."""
    own = made_of(epochs)
    if isinstance(own, Wide):
        mean = lambda c: F.avg(F.when(F.col("time").between(first, last), F.col(c))).over(W.partitionBy(*EPOCH))
        return melt(own.rows.withColumns({c: F.col(c) - mean(c) for c in own.channels}), own.channels, ("recording", "epoch", "condition", "time"))
    mean = F.avg(F.when(F.col("time").between(first, last), F.col("value"))).over(W.partitionBy(*EPOCH, "channel"))
    return epochs.withColumn("value", F.col("value") - mean)


def detrend(epochs: DataFrame) -> DataFrame:
    """Values minus the straight line fitted to each epoch and channel."""
    group = W.partitionBy(*EPOCH, "channel")
    t, v = F.col("time").cast("double"), F.col("value")
    slope = F.covar_pop(t, v).over(group) / F.nullif(F.var_pop(t).over(group), F.lit(0.0))
    return epochs.withColumn("value", v - F.avg(v).over(group) - F.coalesce(slope, F.lit(0.0)) * (t - F.avg(t).over(group)))


def rejected(epochs: DataFrame, reject: float | dict[str, float] | None = None, flat: float | dict[str, float] | None = None, channels: DataFrame | None = None) -> DataFrame:
    """(recording, epoch, reason, channels): epochs with a channel's range over ``reject``, or else below ``flat``; three channels at most are named.

    Limits are numbers, or numbers by type of channel, for which ``channels`` (recording, channel, ch_type, bad) is needed; with
    it, channels marked bad have no say, and one number is meant for EEG.
    """
    ptp = epochs.groupBy(*EPOCH, "channel").agg((F.max("value") - F.min("value")).alias("ptp"))
    if channels is not None:
        ptp = ptp.join(channels.where("not bad").select("recording", "channel", "ch_type"), ["recording", "channel"])
    elif isinstance(reject, dict) or isinstance(flat, dict):
        raise ValueError("limits by type need the table of channels")

    def limit(x) -> Column:
        if x is None:
            return F.lit(None).cast("double")
        if channels is None:
            return F.lit(float(x))
        by_type = x if isinstance(x, dict) else {"eeg": x}
        return F.try_element_at(F.create_map(*(F.lit(v) for k, y in by_type.items() for v in (k, float(y)))), F.col("ch_type"))

    marked = ptp.withColumn("reason", F.when(F.col("ptp") > limit(reject), "REJECT").when(F.col("ptp") < limit(flat), "FLAT")).where("reason is not null")
    found = marked.groupBy(*EPOCH).agg(F.max("reason").alias("reason"), F.sort_array(F.collect_list(F.struct("reason", "channel"))).alias("c"))
    names = F.transform(F.filter("c", lambda x: x["reason"] == F.col("reason")), lambda x: x["channel"])
    return found.select(*EPOCH, "reason", F.array_join(F.slice(names, 1, 3), ",").alias("channels"))


def drop(epochs: DataFrame, found: DataFrame) -> DataFrame:
    return epochs.join(found.select(*EPOCH), EPOCH, "left_anti")


def average(epochs: DataFrame, by: tuple[str, ...] = ("recording", "condition")) -> DataFrame:
    """Evoked responses: means over epochs, (by, channel, time, value, n)."""
    own = made_of(epochs)
    if isinstance(own, Wide):
        means = own.rows.groupBy(*by, "time").agg(*(F.avg(c).alias(c) for c in own.channels), F.count("*").alias("_n"))
        cells = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in own.channels))
        return means.select(*by, "time", "_n", F.explode(cells).alias("_c")).select(*by, "_c.channel", "time", "_c.value", F.col("_n").alias("n"))
    return epochs.groupBy(*by, "channel", "time").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def gfp(evoked: DataFrame, by: tuple[str, ...] = ("recording", "condition")) -> DataFrame:
    """Global field power: the population standard deviation over channels at each time."""
    return evoked.groupBy(*by, "time").agg(F.stddev_pop("value").alias("gfp"))


def peak(evoked: DataFrame, first: int, last: int, mode: str = "abs", by: tuple[str, ...] = ("recording", "condition")) -> DataFrame:
    """(by, channel, time, value) of the largest value (abs), maximum (pos) or minimum (neg) in a window; the first of equals."""
    score: Column = {"abs": F.abs("value"), "pos": F.col("value"), "neg": -F.col("value")}[mode]
    within = evoked.where(F.col("time").between(first, last))
    best = W.partitionBy(*by).orderBy(score.desc(), "channel", "time")
    return within.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*by, "channel", "time", "value")


def summary(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("recording", "condition").agg(F.countDistinct("epoch").alias("n_epochs"))
