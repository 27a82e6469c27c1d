"""What keeps one task's share bounded and samples from being sent again: the same results from arrays, ranges and single passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurosheaf import queries
from neurosheaf.operators import artifacts, bad_channels, connectivity, filtering, ranking, signals, spectral, windowing

from .test_made_of import forgotten, sorted_rows, wide

SMALLEST = "/root/testdata/sf0.001"


def optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def executed(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def same(got, want, *keys):
    got, want = sorted_rows(got.select(want.columns), *keys), sorted_rows(want, *keys)
    assert len(want) and got[list(keys)].equals(want[list(keys)])
    for c in want.columns:
        if c not in keys:
            assert all(np.allclose(np.array(g, float), np.array(w, float), equal_nan=True) for g, w in zip(got[c], want[c], strict=True)), c


def test_trials_are_placed_by_ranges(spark, monkeypatch):
    """A channel's trials go to several tasks; ties and the edges of ranges don't matter."""
    monkeypatch.setattr(ranking, "TASK_TRIALS", 40)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=400) * 8)  # many ties
    rows = pd.DataFrame({"recording": 0, "channel": np.repeat(["a", "b"], 200), "trial": np.tile(np.arange(200), 2), "condition": np.tile(["p", "q", "q", "o"], 100), "value": x})
    got = {r.channel: r.auc for r in ranking.auc(spark.createDataFrame(rows), "p", "q").collect()}
    for c, own in rows.groupby("channel"):
        p, q = (own.value[own.condition == k].to_numpy() for k in "pq")
        u = ((p[:, None] > q) + (p[:, None] == q) / 2).mean()
        assert got[c] == pytest.approx(max(u, 1 - u))


def test_trials_are_not_joined_by_recording(spark):
    """One recording is one key: a join on it alone would put all trials into one task."""
    rows = pd.DataFrame({"recording": 0, "channel": "a", "trial": np.arange(40), "condition": np.tile(["p", "q"], 20), "feature": "f", "value": np.arange(40.0)})
    lines = optimized(ranking.discriminability(spark.createDataFrame(rows)))
    assert sum("Join Inner, (recording" in line for line in lines) == 1  # rows a condition, for the test


def test_times_of_a_recording_are_told_without_its_trials(spark):
    rows = pd.DataFrame({"recording": 0, "channel": "a", "trial": np.repeat(np.arange(4), 10), "condition": "p", "time": np.tile(np.arange(10), 4), "value": np.tile(np.arange(10.0), 4)})
    found = ranking.bin_features(spark.createDataFrame(rows))
    assert not any(line.strip(" +-:").startswith("Window") for line in optimized(found))
    assert sorted((r.trial, r.feature, r.value) for r in found.collect()) == [(k, i, 2 * i + 0.5) for k in range(4) for i in range(5)]


def test_tasks_of_the_view_are_bounded(spark, monkeypatch):
    want = sorted_rows(windowing.stim_events(queries.sig(spark, SMALLEST)), "recording", "channel", "sample")
    monkeypatch.setattr(queries, "TASK_ROWS", 500)
    made = queries.sig(spark, SMALLEST)
    assert made.rdd.getNumPartitions() == made.select("recording", "sample").distinct().count() // 500 > 8
    assert sorted_rows(windowing.stim_events(made), "recording", "channel", "sample").equals(want)


@pytest.mark.parametrize("query", ["stim_events", "clipping_fraction"])
def test_samples_are_not_joined_with_what_they_give(spark, query):
    lines = executed(queries.QUERIES[query](spark, SMALLEST))
    assert not any("Join" in line for line in lines) and sum("Exchange" in line for line in lines) == 1


def test_segments_of_wide_rows(spark, monkeypatch):
    monkeypatch.setattr(signals, "CHUNK", 50)
    samples = signals.drop_channels(signals.melt(wide(spark), ["x", "y", "z"]), ["z"])
    for length, step in ((20, 7), (20, 20), (3, 1), (64, 32)):
        got, want = (signals.transformed(s, length, step, lambda x: x, "v") for s in (samples, forgotten(samples)))
        assert not any("sequence" in line and "segment" in line for line in optimized(got))
        same(got, want, "recording", "channel", "segment")
    same(spectral.welch(samples, 100.0, 0.4), spectral.welch(forgotten(samples), 100.0, 0.4), "recording", "channel", "freq")
    for method in ("coherence", "wpli"):
        same(*(connectivity.spectral(s, 100.0, 8.0, 30.0, method, 0.4) for s in (samples, forgotten(samples))), "recording", "a", "b")


def test_mains_are_found_in_one_pass(spark):
    """Both lines, none, and a tie's first; the samples are in the plan once."""
    t, rng = np.arange(2000) / 250, np.random.default_rng(5)
    tone = lambda f: 5 * np.sin(2 * np.pi * f * t)
    parts = {"fifty": tone(50), "sixty": tone(60), "none": 0 * t}
    rows = pd.concat(pd.DataFrame({"recording": r, "sample": np.arange(len(t)), **{c: x + rng.normal(size=len(t)) for c in "ab"}}) for r, x in parts.items())
    samples = signals.melt(spark.createDataFrame(rows), ["a", "b"])
    for s in (samples, forgotten(samples)):
        found = artifacts.mains(s, 250.0)
        assert {r.recording: r.line for r in found.collect()} == {"fifty": 50.0, "sixty": 60.0, "none": None}
        assert not any("Union" in line for line in optimized(found)) and sum("LogicalRDD" in line or "Relation" in line for line in optimized(found)) == 1
    assert {r.recording: r.line for r in artifacts.mains(samples, 90.0).collect()} == dict.fromkeys(parts)


def test_pieces_of_whole_channels(spark):
    """Arrays are cut into blocks, with and without gaps, as samples are grouped."""
    samples = filtering.band_filter(signals.melt(wide(spark), ["x", "y", "z"]), 1.0, 30.0, 100.0)
    assert isinstance(signals.made_of(samples), signals.Whole)
    for size in (64, 4096):
        got, want = connectivity.correlation(samples, size), connectivity.correlation(forgotten(samples), size)
        assert "places" in got._jdf.queryExecution().optimizedPlan().toString()
        same(got, want, "recording", "a", "b")
    same(connectivity.window_correlations(samples, 10), connectivity.window_correlations(forgotten(samples), 10), "recording", "window", "a", "b")
    got, want = (windowing.hopping_extremes(s, 10, 5) for s in (samples, forgotten(samples)))
    assert not any("sequence" in line for line in optimized(got))
    same(got, want, "recording", "channel", "window")


def test_muscle_bursts_over_blocks(spark, monkeypatch):
    """Bursts across the edges of blocks, of channels of different lengths; only samples over the threshold are rows."""
    rng, parts = np.random.default_rng(2), []
    for r, c, n in (("r", "a", 3000), ("r", "b", 3000), ("r", "c", 2000), ("s", "a", 1500)):
        x = rng.normal(size=n)
        x[950:1100] *= 30
        parts.append(pd.DataFrame({"recording": r, "channel": c, "sample": np.arange(n), "value": x}))
    samples = spark.createDataFrame(pd.concat(parts))
    want = sorted_rows(artifacts.muscle(samples, 200.0), "recording", "onset")
    assert {"r", "s"} == set(want.recording)
    monkeypatch.setattr(artifacts, "MEAN_BLOCK", 256)
    got = artifacts.muscle(samples, 200.0)
    assert not any("avg(value" in line for line in optimized(got))
    assert sorted_rows(got, "recording", "onset").equals(want)


def test_missing_values_are_told_by_the_same_pass(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"recording": "r", "sample": np.arange(600), **{c: rng.normal(size=600) for c in "abcd"}}))
    rows = rows.withColumns({"a": F.when(F.col("sample") != 5, F.col("a")), "b": F.when(F.col("sample") == 7, F.lit(float("nan"))).otherwise(F.col("b"))})
    found = bad_channels.find_bad_channels(signals.melt(rows, list("abcd")), 100.0)
    assert {r.channel: r["nan"] for r in found.collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert not any("sample#" in line and "isnan" in line for line in optimized(found))
