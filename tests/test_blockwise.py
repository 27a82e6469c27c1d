"""Filters in blocks against the same filters over whole channels."""

import numpy as np
import pandas as pd
import pytest

from neurosheaf.functions import filters
from neurosheaf.operators import blockwise, filtering

RATE = 200.0


def channel(n, seed, start=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"recording": "r", "channel": f"c{seed}", "sample": start + np.arange(n), "value": 40.0 + np.cumsum(rng.standard_normal(n))})


def by_channel(df):
    return {c: g.sort_values("sample") for c, g in df.toPandas().groupby("channel")}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blockwise, "RUN", 4)
    return 100


@pytest.mark.parametrize("band", [(1.0, 40.0), (0.5, None), (None, 30.0), (55.0, 45.0)])
@pytest.mark.parametrize("zero_phase", [True, False])
def test_iir_in_blocks_equals_the_whole_channel(spark, small, band, zero_phase):
    # Fifty blocks, a first one of few samples, one just full, and channels shorter than the extension.
    parts = [channel(5003, 1), channel(5000, 2, 97), channel(100, 3), channel(101, 4), channel(17, 5, 95), channel(2, 6), channel(1, 7)]
    sos = filters.butterworth(*band, RATE)
    size = max(small, blockwise.padding(sos) // 4)
    got = by_channel(blockwise.from_blocks(blockwise.iir(blockwise.in_blocks(spark.createDataFrame(pd.concat(parts)), size=size), sos, zero_phase)))
    for part in parts:
        x, own = part.value.to_numpy(), got[part.channel.iloc[0]]
        want = filters.zero_phase(sos, x) if zero_phase else filters.causal(sos, x)[0]
        assert own["sample"].tolist() == part["sample"].tolist()
        assert np.abs(own.value.to_numpy() - want).max() < 1e-9 * max(1.0, np.abs(x).max()), part.channel.iloc[0]


@pytest.mark.parametrize("zero_phase", [True, False])
def test_fir_in_blocks_equals_the_whole_channel(spark, zero_phase):
    parts = [channel(4003, 1), channel(4000, 2, 611), channel(620, 3), channel(621, 4), channel(40, 5, 600), channel(2, 6), channel(1, 7)]
    taps = filters.windowed_sinc(5.0, 40.0, RATE)
    got = by_channel(blockwise.fir(spark.createDataFrame(pd.concat(parts)), taps, zero_phase, size=10))
    for part in parts:
        x, own = part.value.to_numpy(), got[part.channel.iloc[0]]
        want = filters.fir_zero_phase(taps, x) if zero_phase else np.convolve(x, taps)[: len(x)]
        assert own["sample"].tolist() == part["sample"].tolist() and np.abs(own.value.to_numpy() - want).max() < 1e-9 * np.abs(x).max()


def test_triggers_and_gaps_stay(spark, small):
    x = channel(1000, 1).drop(index=range(300, 320))
    codes = channel(1000, 2).assign(channel="STI", value=5.0)
    triggers = spark.createDataFrame([("r", "STI")], "recording string, channel string")
    rows = spark.createDataFrame(pd.concat([x, codes]))
    got = by_channel(blockwise.from_blocks(blockwise.iir(blockwise.in_blocks(rows, triggers, 130), filters.notch(50, RATE))))
    assert (got["STI"].value == 5.0).all() and got["c1"]["sample"].tolist() == x["sample"].tolist()
    assert np.abs(got["c1"].value.to_numpy() - filters.zero_phase(filters.notch(50, RATE), x.value.to_numpy())).max() < 1e-8
    for method in ("iir", "fir"):
        whole = by_channel(filtering.band_filter(rows, 5.0, 40.0, RATE, method, triggers=triggers))
        assert (whole["STI"].value == 5.0).all() and len(whole["STI"]) == 1000
    assert blockwise.from_blocks(blockwise.iir(blockwise.in_blocks(rows.limit(0)), filters.notch(50, RATE))).count() == 0


def test_notch_with_harmonics(spark, small):
    x = channel(3000, 3)
    got = by_channel(filtering.notch_filter(spark.createDataFrame(x), 30.0, RATE))["c3"].value.to_numpy()
    want = x.value.to_numpy()
    for f in (30.0, 60.0, 90.0):
        want = filters.zero_phase(filters.notch(f, RATE), want)
    assert np.abs(got - want).max() < 1e-8


def test_no_group_holds_a_channel(spark, small):
    rows = blockwise.in_blocks(spark.createDataFrame(channel(5000, 1)), size=100)
    passed = blockwise._from_rest(rows, filters.notch(50, RATE))
    assert rows.count() == 50 and max(len(r["values"]) for r in passed.collect()) == 100
    assert max(len(r["head"]) for r in passed.collect()) <= blockwise.padding(filters.notch(50, RATE)) + 1
