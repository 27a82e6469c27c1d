import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurosheaf.functions import distributions
from neurosheaf.functions.montage import project, standard_positions
from neurosheaf.operators import epochs, features, quality, ranking, spectral
from neurosheaf.sources import montages, store

from .test_signals import frame


def test_tails():
    assert distributions.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert distributions.t_two_sided(0.0, 7) == pytest.approx(1.0)
    assert distributions.f_upper(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert distributions.f_upper(2.0, 2, 20) == pytest.approx((1 + 2 * 2.0 / 20) ** -10, rel=1e-9)
    assert distributions.incomplete_beta(2, 3, 0.4) == pytest.approx(sum(math.comb(4, j) * 0.4**j * 0.6 ** (4 - j) for j in range(2, 5)))


def test_tests_of_trials(spark):
    rng = np.random.default_rng(0)
    rows = [("r", c, "ab"[i % 2], float(rng.normal(gap * (i % 2), 1))) for c, gap in (("x", 1.5), ("y", 0.0)) for i in range(80)]
    t = spark.createDataFrame(rows, "recording string, channel string, condition string, value double")
    p = {r.channel: r.p_value for r in ranking.with_p(ranking.welch_t(t, "a", "b")).collect()}
    f = {r.channel: (r.f, r.p_value) for r in ranking.with_p(ranking.anova(t)).collect()}
    assert p["x"] < 1e-4 < 0.01 < p["y"] and f["x"][1] < 1e-4
    assert f["x"][1] == pytest.approx(p["x"], rel=0.5)


def test_background_without_a_peak(spark):
    freqs = np.arange(1, 46, 0.5)
    power = 100 * freqs**-1.3 * np.where(np.abs(freqs - 10) < 2, 6.0, 1.0)
    psd = spark.createDataFrame([("r", "a", float(f), float(p)) for f, p in zip(freqs, power, strict=True)], "recording string, channel string, freq double, power double")
    got = spectral.fit_aperiodic(psd).first()
    assert got.exponent == pytest.approx(1.3, abs=0.05) and got.offset == pytest.approx(2, abs=0.1)


def test_spectrum_between_bad_spans(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(2000) / 100)
    x[500:520] = 1e6
    spans = spark.createDataFrame([("r", 495, 525), ("r", 1990, 1995)], "recording string, start long, end long")
    psd = {r.freq: r.power for r in spectral.welch_without_bad(frame(spark, a=x), spans, 100, 1.0).collect()}
    assert max(psd, key=psd.get) == 10 and sum(psd.values()) == pytest.approx(0.5, rel=0.01)


def test_all_features(spark):
    x = np.random.default_rng(1).standard_normal(1000)
    row = features.channel_features(frame(spark, a=x, b=np.zeros(1000)), 100).where("channel = 'a'").first().asDict()
    assert row["theta_beta"] > 0 and 0.9 < row["spectral_entropy"] <= 1 and row["katz_fd"] > 1 and row["alpha_relative"] < 0.5


def test_events_by_annotation_or_trigger(spark):
    notes = spark.createDataFrame([("r", 1.0, 0.0, "go 4"), ("q", 0.5, 0.1, "BAD x")], "recording string, onset double, duration double, description string")
    line = np.zeros(50)
    line[7:9] = 2
    stim = frame(spark, s=line).unionByName(frame(spark, s=line).replace("r", "q", "recording"))
    got = {(r.recording, r["sample"], r.code) for r in epochs.find_events(notes, stim, 10).collect()}
    assert got == {("r", 10, 4), ("q", 7, 2)}
    table = spark.createDataFrame([("r", 0, "c", "a", [1.0, 2.0])], "recording string, epoch int, condition string, channel string, values array<double>")
    assert [(r.time, r.value) for r in epochs.from_arrays(table, -1).collect()] == [(-1, 1.0), (0, 2.0)]


def test_positions_from_files(tmp_path):
    at = {n: standard_positions()[n] for n in ("Cz", "Fp1", "O2", "T7", "T8", "Pz", "Fz")}
    far = {n: tuple(np.array(p) * 90 + [5, 10, 20]) for n, p in at.items()}
    texts = {
        "a.csv": "name,x,y,z\n" + "\n".join(f"{n},{p[0]},{p[1]},{p[2]}" for n, p in far.items()),
        "b.sfp": "\n".join(f"{n}\t{p[0]}\t{p[1]}\t{p[2]}" for n, p in far.items()),
        "c.elc": "# x\n" + "\n".join(f"{n} : {p[0]} {p[1]} {p[2]}" for n, p in far.items()),
        "d.elc": "Positions\n" + "\n".join(f"{p[0]} {p[1]} {p[2]}" for p in far.values()) + "\nLabels\n" + " ".join(far),
        "e.ced": "Number\tlabels\ttheta\tX\tY\tZ\n" + "\n".join(f"1\t{n}\t0\t{p[1]}\t{-p[0]}\t{p[2]}" for n, p in far.items()),
        "f.loc": "\n".join(f"{i} {90 - math.degrees(math.atan2(p[1], p[0]))} {math.acos(p[2]) / math.pi} {n}" for i, (n, p) in enumerate(at.items())),
    }
    for name, text in texts.items():
        store.write(f"{tmp_path}/{name}", text.encode())
        got = montages.read(f"{tmp_path}/{name}")
        assert set(got) == set(at) and all(np.allclose(got[n], p, atol=1e-6) for n, p in at.items()), name
    store.write(f"{tmp_path}/g.csv", b"nothing")
    with pytest.raises(ValueError):
        montages.read(f"{tmp_path}/g.csv")
    assert project(0, 1, 0) == pytest.approx((0, 1))


def test_discriminability_names_the_best_feature(spark):
    """A rhythm of 10 Hz in one condition: mu tells them apart, with an AUC near 1 and a small p."""
    rng, t = np.random.default_rng(21), np.arange(128) / 128
    rows = []
    for i in range(40):
        for c, gain in (("with", 3.0), ("none", 0.0)):
            x = rng.standard_normal(128) + gain * (i % 2) * np.sin(2 * np.pi * 10 * t + rng.uniform(0, 6))
            rows += [("r", c, i, "ab"[i % 2], k, float(v)) for k, v in enumerate(x)]
    trials = spark.createDataFrame(rows, "recording string, channel string, trial long, condition string, time long, value double")
    features = ranking.band_features(trials, 128.0)
    assert features.count() == 40 * 2 * 2
    found = {r.channel: r for r in ranking.rank_trials(trials, "discriminability", sfreq=128.0).collect()}
    assert found["with"].rank == 1 and found["with"].feature == "mu" and found["with"].auc > 0.95 and found["with"].p_value < 1e-6
    assert found["none"].auc < 0.75
    three = features.withColumn("condition", F.concat("condition", (F.col("trial") % 3).cast("string")))
    assert all(r.auc is None and r.p_value is not None for r in ranking.discriminability(three).collect())
    both = {r.channel: r.accuracy for r in ranking.decoding_accuracy(features, repeats=1, together=True).collect()}
    assert set(both) == {"with", "none", "all"} and min(both["with"], both["all"]) > 0.85


def test_folds_deal_out_every_condition(spark):
    trials = spark.createDataFrame([("r", i, "ab"[i < 7]) for i in range(40)], "recording string, trial long, condition string")
    folds = ranking.with_folds(trials, 5, 3, 1).collect()
    assert len(folds) == 40 and all(len(r.folds) == 3 for r in folds)
    for repeat in range(3):
        for c in "ab":
            sizes = np.bincount([r.folds[repeat] for r in folds if r.condition == c], minlength=5)
            assert sizes.max() - sizes.min() <= 1
    assert {tuple(r.folds) for r in folds} != {(r.folds[0],) * 3 for r in folds}


def test_shrinkage_lies_between_the_sample_and_its_target():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 6)) * [1, 2, 3, 4, 5, 6]
    x -= x.mean(axis=0)
    sample, shrunk = x.T @ x / 30, ranking.shrunk_covariance(x)
    assert np.trace(shrunk) == pytest.approx(np.trace(sample))
    share = 1 - shrunk[0, 1] / sample[0, 1]
    assert 0 < share < 1 and shrunk == pytest.approx((1 - share) * sample + share * np.eye(6) * np.trace(sample) / 6)
    direct = np.mean([((np.outer(r, r) - sample) ** 2).sum() for r in x]) / 30 / ((sample - np.eye(6) * np.trace(sample) / 6) ** 2).sum()
    assert share == pytest.approx(direct)


def test_rejection_by_type(spark):
    rows = [("r", e, c, k, "x", float(v * k)) for e, c, v in ((0, "a", 5), (0, "b", 500), (1, "a", 200), (1, "b", 1), (2, "a", 5), (2, "b", 1), (2, "e", 900)) for k in (0, 1)]
    cut = spark.createDataFrame(rows, "recording string, epoch long, channel string, time long, condition string, value double")
    table = spark.createDataFrame([("r", "a", "eeg", False), ("r", "b", "eeg", True), ("r", "e", "eog", False)], "recording string, channel string, ch_type string, bad boolean")
    assert {(r.epoch, r.channels) for r in epochs.rejected(cut, 100.0).collect()} == {(0, "b"), (1, "a"), (2, "e")}
    assert {(r.epoch, r.channels) for r in epochs.rejected(cut, 100.0, None, table).collect()} == {(1, "a")}
    assert {(r.epoch, r.channels) for r in epochs.rejected(cut, {"eeg": 100.0, "eog": 800.0}, {"eeg": 10.0}, table).collect()} == {(0, "a"), (1, "a"), (2, "e")}
    with pytest.raises(ValueError):
        epochs.rejected(cut, {"eeg": 100.0})


def test_band_power_of_trials_is_that_of_welch(spark):
    """Windows of a second within trials of 2.5 s: the same as the power of spectral.welch() over each trial as a channel."""
    rng = np.random.default_rng(5)
    rows = [("r", "c", i, "ab"[i % 2], k, float(v)) for i in range(4) for k, v in enumerate(rng.standard_normal(320))]
    trials = spark.createDataFrame(rows, "recording string, channel string, trial long, condition string, time long, value double")
    got = {(r.trial, r.feature): r.value for r in ranking.band_features(trials, 128.0).collect()}
    as_channels = trials.select("recording", F.col("trial").cast("string").alias("channel"), F.col("time").alias("sample"), "value")
    power = spectral.band_power(spectral.welch(as_channels, 128.0, 1.0), ranking.MOTOR)
    want = {(int(r.channel), r.band): np.log10(r.power) for r in power.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_two_conditions_are_tested_by_welch(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 12), rng.normal(1, 3, 30)
    rows = [("r", "c", i, "a" if i < 12 else "b", "f", float(v)) for i, v in enumerate([*a, *b])]
    features = spark.createDataFrame(rows, "recording string, channel string, trial long, condition string, feature string, value double")
    (r,) = ranking.discriminability(features).collect()
    va, vb = a.var(ddof=1) / 12, b.var(ddof=1) / 30
    t, df = (a.mean() - b.mean()) / np.sqrt(va + vb), (va + vb) ** 2 / (va**2 / 11 + vb**2 / 29)
    x = np.linspace(0, abs(t), 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / np.sqrt(np.pi * df) * (1 + x * x / df) ** (-(df + 1) / 2)
    assert abs(r.p_value - (1 - 2 * np.trapezoid(density, x))) < 1e-8


def test_channels_shorter_than_a_window_are_judged_as_a_whole(spark):
    rng = np.random.default_rng(7)
    rows = [("r", c, k, float(v)) for c in ("A", "B", "C") for k, v in enumerate(20 * rng.standard_normal(200))] + [("r", "D", k, 0.0) for k in range(200)]
    got = {r.channel: r for r in quality.assess(spark.createDataFrame(rows, "recording string, channel string, sample long, value double"), 256.0).collect()}
    assert all(got[c].flat_fraction == 0 and got[c].score > 50 for c in "ABC") and got["D"].flat_fraction == 1 and got["D"].score == 0
