"""The distributed fit against the same rounds over whole matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurosheaf.operators import channels, ica
from neurosheaf.plans.pipeline import STEPS, Pipeline


def recording(name, n=3000, seed=0, names=("A", "B", "C", "D")):
    rng = np.random.default_rng(seed)
    sources = np.stack([np.sign(rng.standard_normal(n)) * rng.exponential(1, n), rng.uniform(-1, 1, n), np.sin(np.arange(n) / 9.0), rng.laplace(size=n)])[: len(names)]
    x = rng.standard_normal((len(names), len(names))) @ sources * 10 + 100.0
    return pd.concat([pd.DataFrame({"recording": name, "channel": c, "sample": np.arange(n), "value": row}) for c, row in zip(names, x, strict=True)])


def whole(x, k=None, seed=0):
    """Unmixing, mixing and shares of a matrix, one expression for each."""
    mean = x.mean(axis=1, keepdims=True)
    cov = (x - mean) @ (x - mean).T / x.shape[1]
    d, e = np.linalg.eigh(cov)
    keep = np.argsort(-d)[:k]
    whiten = (e[:, keep] / np.sqrt(d[keep])).T
    z = whiten @ (x - mean)
    orthogonal = lambda m: (lambda u, _, v: u @ v)(*np.linalg.svd(m))
    w = orthogonal(np.random.default_rng(seed).normal(size=(len(z), len(z))))
    for _ in range(1000):
        y = np.tanh(w @ z)
        new = orthogonal(y @ z.T / z.shape[1] - np.diag((1 - y**2).mean(axis=1)) @ w)
        done = np.abs((new * w).sum(axis=1)).min() > 1 - 1e-4
        w = new
        if done:
            break
    u = w @ whiten
    m = np.linalg.pinv(u)
    share = (m**2).sum(axis=0) / np.trace(cov)
    order = np.argsort(-share)
    return u[order], m[:, order], share[order]


@pytest.mark.parametrize("k", [None, 2])
@pytest.mark.parametrize("block", [1 << 14, 130])
def test_components_equal_those_of_the_whole_matrix(spark, monkeypatch, k, block):
    monkeypatch.setattr(ica, "BLOCK", block)
    monkeypatch.setattr(ica, "MODELS", 1000)
    parts = [recording("r", 3000, 1), recording("s", 700, 2, ("A", "C", "X"))]
    # A sample that one channel lacks isn't used, nor a stretch without a channel.
    parts[1] = parts[1][~((parts[1].channel == "X") & parts[1]["sample"].isin([5, *range(400, 600)]))]
    model = ica.fit(spark.createDataFrame(pd.concat(parts)), k).toPandas()
    for part in parts:
        x = part.pivot(index="sample", columns="channel", values="value").dropna()
        own = model[model.recording == part.recording.iloc[0]]
        u, m, share = whole(x.to_numpy().T, k)
        table = lambda c: own.pivot(index="component", columns="channel", values=c).to_numpy()  # noqa: B023, E731
        assert np.abs(table("unmixing") - u).max() < 1e-6 * np.abs(u).max() and np.abs(table("mixing") - m.T).max() < 1e-6 * np.abs(m).max()
        assert np.abs(own.groupby("component").variance.first().to_numpy() - share).max() < 1e-9
        assert k is None or own.groupby("component").variance.first().sum() < 1 - 1e-6


def test_no_task_holds_a_recording(spark, monkeypatch):
    monkeypatch.setattr(ica, "BLOCK", 100)
    blocks = ica.in_blocks(spark.createDataFrame(recording("r")))
    assert blocks.count() == 30 and blocks.agg(F.max("n")).first()[0] == 100


def test_all_samples_of_a_long_recording_are_fitted(spark):
    at = spark.range(200_002).select(F.lit("r").alias("recording"), F.col("id").alias("sample"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    rows = at.select("recording", F.lit("A").alias("channel"), "sample", F.col("x").alias("value")).union(at.select("recording", F.lit("B"), "sample", F.col("y") + F.col("sample") % 2))
    mean = lambda **o: {r.channel: r["mean"] for r in ica.fit(rows, **o).collect()}["B"]
    assert abs(mean() - 1.0) < 0.01
    assert abs(mean(decim=2) - 0.5) < 0.01
    assert ica.fit(rows.limit(0)).count() == 0


OPTIONS = {
    "filter": {"low": 1.0, "high": 30.0}, "bandpass": {"low": 1.0, "high": 30.0, "method": "fir"}, "notch": {"frequency": 20.0}, "resample": {"sfreq": 100.0}, "crop": {"tmin": 0.0, "tmax": 8.0}, "pick": {"channels": ["eeg", "stim"]},
    "drop_channels": {"channels": ["Fz"]}, "rename_channels": {"names": {"Fz": "F0"}}, "standardize_names": {}, "set_channel_types": {"types": {"C3": "eeg"}}, "set_montage": {}, "set_bads": {"channels": ["C3"]},
    "detect_bad_channels": {}, "interpolate_bads": {}, "interpolate_bad_channels": {}, "reference": {}, "rereference": {"reference": "median"}, "bipolar": {"pairs": [["Fp1", "C3"], ["Fp2", "Fz"]]}, "laplacian": {"k": 2}, "ica": {}, "annotate_artifacts": {}, "envelope": {"low": 4.0, "high": 30.0},
}


def eeg(spark):
    names = ("Fp1", "Fp2", "C3", "Fz")
    rows = recording("r", 800, 3, names)
    sample = np.arange(800)
    codes = pd.DataFrame({"recording": "r", "channel": "STI 014", "sample": sample, "value": np.where(sample // 50 % 4 == 1, 5.0, 0.0)})
    return spark.createDataFrame(pd.concat([rows, codes]).reset_index(drop=True))


def test_every_step_has_its_options():
    assert set(OPTIONS) == set(STEPS)


@pytest.mark.parametrize("step", sorted(OPTIONS))
def test_a_trigger_line_stays_as_it_is(spark, step):
    samples = eeg(spark)
    placed = channels.set_montage(channels.described(samples))
    out = Pipeline([("set_bads", {"channels": ["C3"]}), (step, OPTIONS[step])] if "interpolate" in step else [(step, OPTIONS[step])]).run(samples, 100.0, placed).samples
    codes = lambda df: [(r["sample"], r["value"]) for r in df.where("channel = 'STI 014' or channel = 'STI014'").orderBy("sample").collect()]
    want = codes(samples)
    assert codes(out) == want


def test_bad_channels_and_spans_are_not_in_the_model(spark):
    samples = eeg(spark)
    table = channels.set_bads(channels.described(samples), ["C3"])
    spans = spark.createDataFrame([("r", 100, 300)], "recording string, start long, end long")
    used = ica.usable(samples, table, spans).toPandas()
    assert set(used.channel) == {"Fp1", "Fp2", "Fz"} and not used["sample"].between(100, 299).any() and len(used) == 3 * 600


def test_bipolar_montages(spark):
    samples = eeg(spark)
    table = channels.set_montage(channels.set_bads(channels.described(samples), ["Fp1"]))
    state = Pipeline([("bipolar", {"pairs": [["Fp1", "C3"], ["Fp2", "Fz"], ["Fp1", "Oz"]]})]).run(samples, 100.0, table)
    rows = {r.channel: r for r in state.channels.collect()}
    at = {r.channel: r for r in table.collect()}
    assert set(rows) == {"Fp1-C3", "Fp2-Fz", "STI 014"} and rows["Fp1-C3"].bad and not rows["Fp2-Fz"].bad
    assert rows["Fp2-Fz"].x == (at["Fp2"].x + at["Fz"].x) / 2 and rows["STI 014"].ch_type == "stim"
    assert set(r.channel for r in state.samples.select("channel").distinct().collect()) == set(rows)
    from neurosheaf.operators import spatial

    assert (len(spatial.BIPOLAR["double_banana"]), len(spatial.BIPOLAR["transverse"])) == (18, 16)
