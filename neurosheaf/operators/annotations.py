"""Annotations: intervals (recording, onset, duration, description) in seconds, and events made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .windowing import merge_intervals, numbered


def is_bad(description: Column) -> Column:
    """Whether an annotation marks data to leave out: it begins with bad, edge or boundary."""
    return F.coalesce(F.trim(F.lower(description)).rlike("^(bad|edge|boundary)"), F.lit(False))


def select(annotations: DataFrame, description: str | list[str] | None = None, regexp: str | None = None) -> DataFrame:
    """Those of a description, of any in a list, or that a regular expression finds something in."""
    if regexp is not None:
        return annotations.where(F.col("description").rlike(regexp))
    names = [description] if isinstance(description, str) else list(description or [])
    return annotations.where(F.col("description").isin(names))


def drop_bad(annotations: DataFrame) -> DataFrame:
    return annotations.where(~is_bad(F.col("description")))


def shift(annotations: DataFrame, seconds: float) -> DataFrame:
    return annotations.withColumn("onset", F.col("onset") + F.lit(float(seconds)))


def crop(annotations: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """Those that meet [tmin, tmax], ends included, cut to it and counted from tmin."""
    lo, hi, end = F.lit(float(tmin)), F.lit(float(tmax)), F.col("onset") + F.col("duration")
    met = annotations.where((end >= lo) & (F.col("onset") <= hi))
    start, stop = F.greatest("onset", lo), F.least(end, hi)
    return met.withColumns({"onset": start - lo, "duration": stop - start})


def counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("recording", "description").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))


def event_codes(annotations: DataFrame) -> DataFrame:
    """(description, code): the number that a description ends with, if it is positive and no earlier one has it;
    the others, in order, get the smallest numbers left. Numbers and the others are counted by ranges of their order, and meet in an equal join."""
    names = annotations.select("description").where("description is not null").distinct()
    number = F.regexp_extract("description", r"(\d{1,9})\s*$", 1).try_cast("int")
    # Descriptions that end with no number are no group of their own: each is its own.
    ranked = kept(names.withColumn("own", F.when(number > 0, number)))
    firsts = ranked.where("own is not null").groupBy("own").agg(F.min("description").alias("description"))
    fixed = kept(firsts.select("description", F.col("own").cast("long").alias("code")))
    rest = kept(ranked.select("description").join(fixed.select("description"), "description", "left_anti"))
    wanted, taken = rest.count(), fixed.count()
    free = annotations.sparkSession.range(1, wanted + taken + 1).select(F.col("id").alias("code")).join(fixed.select("code"), "code", "left_anti")
    given = numbered(rest, "description").join(numbered(free, "code"), "place").select("description", "code")
    return fixed.unionByName(given).select("description", F.col("code").cast("int").alias("code"))


def to_events(annotations: DataFrame, codes: DataFrame, sfreq: float) -> DataFrame:
    """(recording, sample, previous, code, description) of annotations whose description has a code."""
    sample = F.rint(F.col("onset") * F.lit(float(sfreq))).cast("long")
    return annotations.join(codes, "description").select("recording", sample.alias("sample"), F.lit(0).cast("long").alias("previous"), F.col("code").cast("long").alias("code"), "description")


def bad_spans(annotations: DataFrame, sfreq: float) -> DataFrame:
    """(recording, start, end) in samples that bad annotations cover, at least one each, overlapping ones merged."""
    start = F.floor(F.col("onset") * float(sfreq)).cast("long")
    end = F.greatest(F.ceil((F.col("onset") + F.col("duration")) * float(sfreq)).cast("long"), start + 1)
    spans = annotations.where(is_bad(F.col("description"))).select("recording", F.greatest(start, F.lit(0)).alias("start"), end.alias("end"))
    return merge_intervals(spans, ["recording"], 0).select("recording", "start", "end")


def bad_time_fraction(lengths: DataFrame, spans: DataFrame) -> DataFrame:
    """Share of each recording's samples inside merged spans; ``lengths``: recording, n_samples."""
    held = spans.join(lengths, "recording").groupBy("recording").agg(F.sum(F.greatest(F.least("end", "n_samples") - F.col("start"), F.lit(0))).alias("bad"))
    return lengths.join(held, "recording", "left").select("recording", (F.coalesce("bad", F.lit(0)) / F.col("n_samples")).alias("bad_time_fraction"))


def by_block(spans: DataFrame, size: int) -> DataFrame:
    """Spans once for each block of ``size`` samples that they touch: an overlap join becomes an equal one."""
    last = F.floor((F.col("end") - 1) / size)
    return spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), last)))


def without_bad(samples: DataFrame, spans: DataFrame, size: int = 4096) -> DataFrame:
    """Samples outside all (merged) spans."""
    placed = samples.withColumn("_block", F.floor(F.col("sample") / size))
    cut = by_block(spans, size).select(F.col("recording").alias("_r"), F.col("block").alias("_b"), "start", "end")
    inside = (F.col("recording") == F.col("_r")) & (F.col("_block") == F.col("_b")) & (F.col("sample") >= F.col("start")) & (F.col("sample") < F.col("end"))
    return placed.join(cut, inside, "left_anti").drop("_block")
