"""Samples that remember what they were made of: the same results, without one row a sample and channel on the way."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from neurosheaf.operators import artifacts, blockwise, epochs, filtering, ica, quality, signals, spatial


def wide(spark, n=300):
    rng = np.random.default_rng(1)
    at = np.r_[np.arange(n), np.arange(7, n, 3)]  # the second recording lacks samples
    rows = pd.DataFrame({"recording": ["a"] * n + ["b"] * (len(at) - n), "sample": at, **{c: rng.normal(size=len(at)) for c in ("x", "y", "z")}})
    rows = spark.createDataFrame(rows)
    return rows.withColumn("y", F.when(F.col("sample") == 10, None).otherwise(F.col("y")))


def forgotten(samples):
    return samples.select(*samples.columns)


def sorted_rows(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_blocks_of_wide_rows_equal_those_of_samples(spark):
    samples = signals.drop_channels(signals.melt(wide(spark), ["x", "y", "z"]), ["z"])
    assert signals.made_of(samples).channels == ["x", "y"] and signals.made_of(forgotten(samples)) is None
    for size in (None, 64):
        got, want = (sorted_rows(blockwise.in_blocks(s, size=size), "recording", "channel", "block") for s in (samples, forgotten(samples)))
        assert got.drop(columns=["numbers", "values"]).equals(want.drop(columns=["numbers", "values"])) and len(got) > 3
        for c in ("numbers", "values"):
            assert all((g is None and w is None) or np.array_equal(np.array(g, float), np.array(w, float), equal_nan=True) for g, w in zip(got[c], want[c], strict=True))


def test_a_filter_of_wide_rows_groups_rows_not_samples(spark):
    plan = filtering.band_filter(signals.melt(wide(spark), ["x", "z"]), 1.0, 30.0, 100.0)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "collect_list" in line]
    assert len(grouped) == 1 and "channel" not in grouped[0].split("], [")[0]


def test_average_reference_of_whole_channels(spark):
    filtered = filtering.band_filter(signals.melt(wide(spark), ["x", "y", "z"]), 1.0, 30.0, 100.0)
    kinds = [("a", "x", "eeg", False), ("a", "y", "eeg", True), ("a", "z", "stim", False), ("b", "x", "eeg", False), ("b", "z", "eeg", False)]
    table = spark.createDataFrame(kinds, "recording string, channel string, ch_type string, bad boolean")
    for options in ({}, {"bad": ["x"]}, {"channels": table}, {"channels": table, "bad": ["z"]}):
        made = spatial.set_reference(filtered, "average", **options)
        assert isinstance(signals.made_of(made), signals.Whole)
        got, want = (sorted_rows(x, "recording", "channel", "sample") for x in (made, spatial.set_reference(forgotten(filtered), "average", **options)))
        assert got[["recording", "channel", "sample"]].equals(want[["recording", "channel", "sample"]])
        assert np.allclose(got.value, want.value, equal_nan=True)


def test_no_spectra_where_no_mains_lie_below_half_the_rate(spark):
    samples = signals.melt(wide(spark), ["x"])
    assert artifacts.auto_notch(samples, 100.0) is samples
    assert artifacts.auto_notch(samples, 120.0) is not samples


def test_epochs_of_wide_rows(spark):
    samples = signals.melt(wide(spark), ["x", "y", "z"])
    events = spark.createDataFrame([("a", 5, 1), ("a", 60, 2), ("a", 62, 1), ("a", 200, 1), ("a", 299, 2), ("b", 100, 1), ("b", 101, 2)], "recording string, sample long, code long")
    lengths = spark.createDataFrame([("a", 300), ("b", 300)], "recording string, n_samples long")
    bad = spark.createDataFrame([("a", 195, 201)], "recording string, start long, end long")
    placed = epochs.place(events, lengths, -0.2, 0.3, 100.0, bad, 16)
    made = {}
    for name, s in (("wide", samples), ("long", forgotten(samples))):
        cut = epochs.baseline(epochs.cut(s, placed, 16), -5, 0)
        made[name] = [cut, epochs.average(cut), epochs.gfp(epochs.average(signals.drop_channels(cut, ["z"]))), epochs.average(cut, ("condition",))]
    assert "Join" not in epochs.cut(samples, placed.select(*placed.columns).localCheckpoint(), 16)._jdf.queryExecution().optimizedPlan().toString()
    for got, want in zip(made["wide"], made["long"], strict=True):
        keys = [c for c in want.columns if c not in ("value", "gfp", "n")]
        got, want = sorted_rows(got.select(want.columns), *keys), sorted_rows(want, *keys)
        assert len(want) and got[keys].equals(want[keys])
        assert all(np.allclose(got[c], want[c], equal_nan=True) for c in want.columns if c not in keys)


def test_components_of_wide_rows_and_of_recordings_in_one_block(spark, monkeypatch):
    samples = signals.melt(wide(spark), ["x", "y", "z"])
    rounds = []
    monkeypatch.setattr(ica, "ROUNDS", 6)
    monkeypatch.setattr(ica, "_round", lambda *a, run=ica._round: rounds.append(1) or run(*a))
    models = [ica.fit(samples).cache(), ica.fit(forgotten(samples)).cache()]
    assert len(sorted_rows(models[0], "recording", "component", "channel")) == 18 and not rounds
    monkeypatch.setattr(ica, "BLOCK", 128)
    models.append(ica.fit(forgotten(samples)).cache())
    assert rounds
    keys = ["recording", "component", "channel"]
    tables = [sorted_rows(m, *keys) for m in models]
    for t in tables[1:]:
        assert t[keys].equals(tables[0][keys]) and np.allclose(t[["unmixing", "mixing", "mean", "variance"]], tables[0][["unmixing", "mixing", "mean", "variance"]])
    got, want = (sorted_rows(ica.sources(s, models[0]), "recording", "channel", "sample") for s in (samples, forgotten(samples)))
    assert got[["recording", "channel", "sample"]].equals(want[["recording", "channel", "sample"]]) and np.allclose(got.value, want.value, equal_nan=True)


def test_channels_are_described_from_blocks(spark):
    samples = signals.melt(wide(spark), ["x", "y"])
    made = quality.described(samples, 100.0, 50, 1.0)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    got, want = (sorted_rows(d, "recording", "channel") for d in (made, quality.described(forgotten(samples), 100.0, 50, 1.0)))
    assert len(got) == 4 and got.n_samples.tolist() == [300, 300, 98, 98]
    for c in got.columns:
        assert all((g is None and w is None) or g == w if isinstance(g, str) or g is None else np.allclose(np.array(g, float), np.array(w, float), equal_nan=True) for g, w in zip(got[c], want[c], strict=True)), c
