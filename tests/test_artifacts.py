import numpy as np
import pandas as pd
import pytest

from neurosheaf import cli
from neurosheaf.functions.montage import standard_positions
from neurosheaf.operators import artifacts, channels, ica, quality, ranking
from neurosheaf.plans import report
from neurosheaf.plans.pipeline import Pipeline
from neurosheaf.sources import files
from neurosheaf.sources.simulate import simulate

from .test_signals import frame

RATE = 256.0


def test_amplitude_muscle_blinks_and_mains(spark):
    rng = np.random.default_rng(0)
    n = int(40 * RATE)
    t = np.arange(n) / RATE
    x = rng.normal(0, 5, (2, n))
    x[0, int(10 * RATE) : int(10.2 * RATE)] += 400
    burst = slice(int(20 * RATE), int(21 * RATE))
    x[:, burst] += rng.normal(0, 60, (2, 256))
    found = artifacts.amplitude(frame(spark, a=x[0], b=x[1]), RATE, high=300.0).collect()
    assert any(f.description == "BAD_amplitude" and f.onset <= 10 <= f.onset + f.duration for f in found)
    muscle = artifacts.muscle(frame(spark, a=x[0], b=x[1]), RATE).collect()
    assert any(19.5 < m.onset < 20.5 and m.duration > 0.5 for m in muscle)
    assert artifacts.muscle(frame(spark, a=x[0]), 40.0).count() == 0
    at = [5.0, 9.0, 15.0, 31.0]
    eye = -sum(120 * np.exp(-(((t - b) / 0.08) ** 2)) for b in at) + rng.normal(0, 2, n)
    got = artifacts.blinks(frame(spark, Fp2=eye, Cz=x[0]), RATE).orderBy("onset").collect()
    middles = [b.onset + b.duration / 2 for b in got]
    assert all(min(abs(m - b) for m in middles) < 0.05 for b in at) and len(got) < 20
    line = {r.recording: r.line for r in artifacts.mains(frame(spark, a=rng.normal(0, 1, n) + 3 * np.sin(2 * np.pi * 60 * t), b=rng.normal(0, 1, n) + np.sin(2 * np.pi * 60 * t)), RATE).collect()}
    assert line == {"r": 60.0}
    assert artifacts.mains(frame(spark, a=rng.normal(0, 1, n)), RATE).first().line is None
    clean = artifacts.auto_notch(frame(spark, a=np.sin(2 * np.pi * 60 * t) + rng.normal(0, 0.05, n)), RATE).toPandas()
    assert clean.value.std() < 0.2


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 0, 0, 5, 0.0])
    at, _ = artifacts.peaks(x, 1.5, 1)
    assert at.tolist() == [3, 6, 9]
    assert artifacts.peaks(x, 1.5, 4)[0].tolist() == [3, 9]
    t = np.arange(200.0)
    _, width = artifacts.peaks(np.exp(-((t - 100) ** 2) / (2 * 10**2)), 0.5, 10)
    assert width[0] == pytest.approx(23.55, abs=0.2)


def test_channel_tables(spark):
    s = frame(spark, **{"EEG Fp1-REF": [1], "Cz": [1], "VEOG": [1], "STI 014": [1]})
    table = channels.described(s)
    names = lambda df: sorted(r.channel for r in df.collect())
    assert names(channels.pick(table, "eeg")) == ["Cz", "EEG Fp1-REF"] and names(channels.pick(table, "fp1")) == ["EEG Fp1-REF"]
    assert names(channels.pick(table, -1)) == ["VEOG"] and names(channels.pick(table, ["cz", "stim"])) == ["Cz", "STI 014"]
    assert names(channels.pick(table)) == sorted(r.channel for r in table.collect()) and names(channels.pick(table, "nothing")) == []
    marked = channels.set_bads(channels.set_montage(table), ["Cz"])
    assert names(channels.pick(marked, "good")) == ["EEG Fp1-REF"] and names(channels.pick(marked, "data", True)) == ["EEG Fp1-REF", "VEOG"]
    assert {r.ch_type: r.n for r in channels.type_counts(channels.set_types(table, {"Cz": "misc"})).collect()} == {"eeg": 1, "misc": 1, "eog": 1, "stim": 1}
    assert names(marked.where("x is not null")) == ["Cz", "EEG Fp1-REF"]
    with pytest.raises(ValueError):
        channels.set_types(table, {"Cz": "x"})


def test_cleaning_pipeline_over_several_recordings(spark):
    names = [n for n, p in standard_positions().items() if p[2] > 0.2][:20]
    made = simulate(spark, 2, names, 20.0, 128.0, {names[3]: "disconnected"}, seed=5)
    steps = ["set_montage", {"notch": {"frequency": "auto"}}, {"step": "filter", "low": 1, "high": 40}, ("set_bads", {"channels": [names[3]]}), "interpolate_bads", "reference", {"annotate_artifacts": {"blinks": False}}]
    state = Pipeline.from_config(steps).run(made, 128.0)
    got = state.samples.toPandas()
    assert got.groupby("recording").channel.nunique().tolist() == [20, 20]
    one = got[got.recording == "r000000"].pivot(index="sample", columns="channel", values="value")
    assert np.abs(one.mean(axis=1)).max() < 1e-9 and one[names[3]].std() < 40
    assert state.annotations.columns == artifacts.ANNOTATION and len(state.history) == 7


def test_blinks_go_with_their_component(spark):
    rng = np.random.default_rng(1)
    n = int(20 * RATE)
    t = np.arange(n) / RATE
    blink = sum(np.exp(-(((t - b) / 0.08) ** 2)) for b in np.arange(1.5, 20, 2.1)) * 150
    brain = np.stack([np.convolve(rng.laplace(0, 1, n), np.ones(5), "same") for _ in range(4)])
    x = rng.normal(0, 1, (5, 4)) @ brain * 3 + np.array([1, 0.9, 0.3, 0.1, 0.05])[:, None] * blink
    s = frame(spark, Fp1=x[0], Fp2=x[1], Fz=x[2], Cz=x[3], Pz=x[4])
    cleaned = Pipeline.from_config([{"ica": {}}]).run(s, RATE).samples.toPandas()
    after = cleaned[cleaned.channel == "Fp1"].sort_values("sample").value.to_numpy()
    assert abs(np.corrcoef(x[0], blink)[0, 1]) > 0.9 > 0.4 > abs(np.corrcoef(after, blink)[0, 1])
    assert ica.component_table(s, ica.fit(s), RATE).count() == 5


def test_rank_dispatch(spark):
    rng = np.random.default_rng(2)
    t = np.arange(int(12 * RATE)) / RATE
    s = frame(spark, alpha=10 * np.sin(2 * np.pi * 10 * t) + rng.normal(0, 1, len(t)), flat=rng.normal(0, 1, len(t)), slow=10 * np.sin(2 * np.pi * 2 * t) + rng.normal(0, 1, len(t)))
    best = lambda by: ranking.rank_channels(s, RATE, by).where("rank = 1").first().channel
    assert best("alpha") == "alpha" and best("delta") == "slow" and best("band:9-11") == "alpha" and best("snr") in ("alpha", "slow")
    assert ranking.rank_channels(s, RATE, "connectivity").count() == 3 and ranking.rank_channels(s, RATE).count() == 3
    with pytest.raises(ValueError):
        ranking.rank_channels(s, RATE, "luck")
    trials = spark.createDataFrame([("r", c, i, str(i % 2), k, float(rng.normal(g * (i % 2) * (k > 5), 1))) for c, g in (("x", 2), ("y", 0)) for i in range(60) for k in range(10)], "recording string, channel string, trial long, condition string, time long, value double")
    assert ranking.rank_trials(trials, "discriminability").where("rank = 1").first().channel == "x"
    assert ranking.rank_trials(trials, "decoding", repeats=2).where("rank = 1").first().channel == "x"
    assert ranking.rank_trials(trials, "erd", active=(6, 9), base=(0, 5)).count() == 2


def test_reports_and_commands(spark, tmp_path, capsys):
    names = ["Fp1", "Fp2", "Cz", "Pz", "O1"]
    files.write(simulate(spark, 1, names, 12.0, 128.0, {"Cz": "flat"}), f"{tmp_path}/in", 128.0).count()
    assessed = quality.assess(files.read(spark, f"{tmp_path}/in"), 128.0)
    advice = report.recommendations(assessed)
    assert "Cz" in " ".join(r.advice for r in advice.collect())
    (made,) = report.write_reports(assessed, advice, f"{tmp_path}/out").collect()
    assert "<svg" in open(made.uri).read()
    cli.run(spark, ["formats"])
    cli.run(spark, ["info", f"{tmp_path}/in"])
    cli.run(spark, ["rank", f"{tmp_path}/in", "--by", "alpha"])
    cli.run(spark, ["convert", f"{tmp_path}/in", f"{tmp_path}/text", "--format", "text"])
    assert ".edf" in capsys.readouterr().out and files.read(spark, f"{tmp_path}/text").count() == 5 * 12 * 128
    grid = report.topomap_grid({"Fp1": 1.0, "Fp2": 1.0, "O1": 0.0, "O2": 0.0, "Cz": 0.5})
    front, back = (np.mean([v for _, y, v in grid if f * y > 0.5]) for f in (1, -1))
    assert front > 0.7 > 0.3 > back
    trials = spark.createDataFrame(pd.DataFrame({"recording": "r", "channel": "a", "trial": 0, "time": np.arange(100), "value": np.r_[np.ones(50), 2 * np.ones(50)]}))
    assert report.erds_timecourse(trials, 20.0, (0, 40)).where("time = 80").first().percent == pytest.approx(300)
