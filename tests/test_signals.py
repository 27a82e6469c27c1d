import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurosheaf.operators import annotations, bad_channels, connectivity, epochs, features, filtering, ica, quality, ranking, signals, spatial, spectral, statistics, windowing
from neurosheaf.plans.pipeline import Pipeline
from neurosheaf.sources.simulate import simulate
from neurosheaf.functions.montage import standard_positions

SCHEMA = "recording string, channel string, sample long, value double"
TEN_TWENTY = ["Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T7", "C3", "Cz", "C4", "T8", "P7", "P3", "Pz", "P4", "P8", "O1", "O2"]


def frame(spark, **channels):
    return spark.createDataFrame(pd.concat(pd.DataFrame({"recording": "r", "channel": c, "sample": np.arange(len(x)), "value": np.asarray(x, float)}) for c, x in channels.items()), SCHEMA)


def one(df, column):
    return {r.channel: r[column] for r in df.collect()}


def test_blocks_and_segments(spark):
    s = frame(spark, a=range(10), b=range(10, 20))
    assert sorted(map(tuple, signals.from_blocks(signals.to_blocks(s, 4)).collect())) == sorted(map(tuple, s.collect()))
    cut = {(r.channel, r.segment): list(r["values"]) for r in signals.segments(s, 4, 2).collect()}
    assert sorted(k for c, k in cut if c == "a") == [0, 1, 2, 3] and cut["a", 3] == [6, 7, 8, 9]
    assert signals.segments(s, 11, 2).count() == 0


def test_crop_append_rename_add(spark):
    s = frame(spark, a=range(10))
    assert [r.value for r in signals.crop(s, 0.2, 0.5, 10).orderBy("sample").collect()] == [2, 3, 4]
    both, seams = signals.append(s, frame(spark, a=[7, 8]))
    assert both.count() == 12 and seams.first()["sample"] == 10 and both.where("sample = 11").first().value == 8
    assert signals.rename_channels(s, {"a": "z"}).select("channel").distinct().first()[0] == "z"
    assert signals.add_channel(s, "d", {"a": 2.0}).where("channel = 'd' and sample = 3").first().value == 6


def test_statistics_of_odd_channels(spark):
    s = frame(spark, flat=[1.0] * 8, odd=[1, 2, np.nan, np.inf, 3, 4, 5, 6])
    t = {r.channel: r for r in statistics.channel_table(s).collect()}
    assert t["odd"].n_missing == 2 and t["odd"]["mean"] == 3.5 and t["flat"]["std"] == 0
    z = statistics.robust_z(spark.createDataFrame([("r", 1.0), ("r", 1.0)], "recording string, v double"), ["recording"], "v")
    assert {r.z for r in z.collect()} == {0.0}
    assert statistics.channel_table(s.limit(0)).count() == 0


def test_clipping_and_runs(spark):
    s = frame(spark, a=[0, 5, 5, 5, 1, 2, 0, 0, 3, 4], c=[2] * 10)
    assert one(windowing.clipping_fraction(s), "clipping_fraction") == {"a": 0.4, "c": 1.0}


def test_trigger_lines(spark):
    pulses = np.zeros(30)
    pulses[5:8], pulses[10], pulses[20:25] = 1, 2, 3
    found = windowing.stim_events(frame(spark, s=pulses), 2).orderBy("sample").collect()
    assert [(r["sample"], r.previous, r.code) for r in found] == [(5, 0, 1), (20, 0, 3)]
    resting = np.full(30, 255.0)
    resting[3:6] = 7
    assert [(r["sample"], r.code) for r in windowing.stim_events(frame(spark, s=resting)).collect()] == [(3, 7)]


def test_merge(spark):
    spans = spark.createDataFrame([("r", 0.0, 10.0), ("r", 2.0, 3.0), ("r", 10.5, 11.0), ("r", 20.0, 21.0)], "recording string, start double, end double")
    assert [(r.start, r.end, r.parts) for r in windowing.merge_intervals(spans, ["recording"], 1.0).orderBy("start").collect()] == [(0, 11, 3), (20, 21, 1)]


def test_features_against_numpy(spark):
    x = np.random.default_rng(0).standard_normal(400)
    s = frame(spark, a=x, c=np.ones(50))
    t = {r.channel: r for r in features.time_features(s, 100).collect()}
    assert t["a"].line_length == pytest.approx(np.abs(np.diff(x)).mean())
    assert t["a"].mobility == pytest.approx(np.sqrt(np.diff(x).var() / x.var()))
    assert t["c"].mobility is None and t["c"].complexity is None
    assert one(features.sample_entropy(s), "sample_entropy")["c"] is None
    m, tol, n = 2, 0.2 * x.std(), 398
    counts = [0, 0]
    for i in range(n):
        for j in range(i + 1, n):
            if max(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) <= tol:
                counts[0] += 1
                counts[1] += abs(x[i + 2] - x[j + 2]) <= tol
    assert one(features.sample_entropy(s), "sample_entropy")["a"] == pytest.approx(-np.log(counts[1] / counts[0]))
    assert one(features.permutation_entropy(s), "permutation_entropy")["a"] > 0.98


def test_annotations(spark):
    a = spark.createDataFrame([("r", 1.0, 2.0, "BAD move"), ("r", 2.5, 1.0, " edge"), ("r", 5.0, 0.0, "go 3"), ("r", 6.0, 0.0, "stop"), ("r", 7.0, 0.0, "x3")], "recording string, onset double, duration double, description string")
    assert annotations.drop_bad(a).count() == 3
    assert {r.description: r.code for r in annotations.event_codes(a).collect()} == {" edge": 1, "BAD move": 2, "go 3": 3, "stop": 4, "x3": 5}
    assert [(r.start, r.end) for r in annotations.bad_spans(a, 10).collect()] == [(10, 35)]
    kept = annotations.crop(a, 3.0, 5.0).orderBy("onset").collect()
    assert [(r.onset, r.duration) for r in kept] == [(0, 0), (0, 0.5), (2, 0)]
    s = frame(spark, a=range(100))
    assert annotations.without_bad(s, annotations.bad_spans(a, 10), 8).count() == 75


def test_epochs(spark):
    s = frame(spark, a=np.arange(100), b=np.arange(100) * 2.0)
    events = spark.createDataFrame([("r", 2, 1), ("r", 50, 1), ("r", 70, 2), ("r", 98, 2)], "recording string, sample long, code long")
    lengths = spark.createDataFrame([("r", 100)], "recording string, n_samples long")
    bad = spark.createDataFrame([("r", 75, 76)], "recording string, start long, end long")
    placed = epochs.place(events, lengths, -0.5, 0.5, 10.0, bad, 16)
    assert [r.dropped for r in placed.orderBy("sample").collect()] == ["OUT_OF_BOUNDS", None, "BAD_ANNOTATION", "OUT_OF_BOUNDS"]
    cut = epochs.baseline(epochs.cut(s, placed, 16), -5, -5)
    assert cut.count() == 22 and cut.where("channel = 'b' and time = 5").first().value == 20
    assert epochs.detrend(cut).agg(F.max(F.abs("value"))).first()[0] < 1e-9
    assert epochs.rejected(cut, 15.0).first().channels == "b"
    assert epochs.peak(epochs.average(cut), -5, 5).first().channel == "b"


def test_spectrum_integrates_to_the_variance(spark):
    x = np.random.default_rng(1).standard_normal(5120)
    s = frame(spark, a=x)
    for psd in (spectral.welch(s, 256, 2.0), spectral.averaged(spectral.multitapers(signals.segments(s, 512, 512), 512, 256.0), 512, 256.0)):
        p = psd.toPandas()
        assert p.power.sum() * 0.5 == pytest.approx(x.var(), rel=0.1)
    tone = frame(spark, a=x * 0.1 + np.sin(2 * np.pi * 10 * np.arange(5120) / 256))
    assert one(spectral.peak_frequency(spectral.welch(tone, 256, 2.0)), "peak_frequency")["a"] == 10


def test_aperiodic_exponent_is_recovered(spark):
    rng = np.random.default_rng(2)
    n = 256 * 60
    f = np.fft.rfftfreq(n, 1 / 256)
    x = np.fft.irfft(np.fft.rfft(rng.standard_normal(n)) / np.maximum(f, 0.5) ** 0.75, n)
    assert one(spectral.aperiodic(spectral.welch(frame(spark, a=x), 256, 4.0)), "exponent")["a"] == pytest.approx(1.5, abs=0.2)


def test_references_and_weights(spark):
    s = frame(spark, a=[1, 2], b=[3, 6], c=[100, 100])
    assert one(spatial.set_reference(s, "average", ["c"]).where("sample = 1"), "value") == {"a": -2, "b": 2, "c": 96}
    assert one(spatial.set_reference(s, "a").where("sample = 0"), "value") == {"a": 0, "b": 2, "c": 99}
    assert one(spatial.bipolar(s, [("b", "a"), ("a", "z")]).where("sample = 0"), "value") == {"b-a": 2}
    assert spatial.add_reference_channel(s, "R").where("channel = 'R'").count() == 2
    with pytest.raises(ValueError):
        spatial.interpolation_weights(spark, {"a": (0, 0, 1)}, {"b": (1, 0, 0)})


def resonance(seed: int, n: int, freq: float, sfreq: float) -> np.ndarray:
    """Noise through a resonator: a rhythm whose phase wanders."""
    drive, y = np.random.default_rng(seed).uniform(-1, 1, n), np.zeros(n)
    for i in range(2, n):
        y[i] = 2 * 0.98 * np.cos(2 * np.pi * freq / sfreq) * y[i - 1] - 0.98**2 * y[i - 2] + drive[i]
    return y


def test_connectivity_of_a_lagged_pair(spark):
    """b follows a by 6 samples, a quarter of a cycle; c is a rhythm of its own."""
    sfreq, n, lag = 256, 6000, 6
    lead, alone = resonance(31, n + lag, 10.5, sfreq), resonance(32, n, 10.5, sfreq)
    s = frame(spark, a=lead[lag:], b=lead[:n], c=alone)
    for method in ("coherence", "imcoh", "pli", "wpli"):
        v = {(r.a, r.b): r.value for r in connectivity.spectral(s, sfreq, 8, 13, method).collect()}
        assert v["a", "b"] > 1.5 * max(v["a", "c"], v["b", "c"]), (method, v)
    v = {(r.a, r.b): r.value for r in connectivity.phase_locking(s, sfreq, 8, 13).collect()}
    assert v["a", "b"] > 0.9 > 0.6 > v["a", "c"]


def test_rankings(spark):
    rng = np.random.default_rng(4)
    rows = [("r", c, i, "ab"[i % 2], float(rng.normal((i % 2) * gap, 1))) for c, gap in (("good", 3.0), ("none", 0.0)) for i in range(120)]
    t = spark.createDataFrame(rows, "recording string, channel string, trial long, condition string, value double")
    for scores, name in ((ranking.fisher(t), "fisher"), (ranking.auc(t, "a", "b"), "auc")):
        assert ranking.ranked(scores, name).where("rank = 1").first().channel == "good"
    d = {r.channel: r for r in ranking.decoding_accuracy(t.withColumn("feature", F.lit(0)), repeats=2).collect()}
    assert d["good"].accuracy > 0.85 > 0.65 > d["none"].accuracy and d["good"].p_value < 1e-6
    a, b = ([r[4] for r in rows if r[1] == "good" and r[3] == k] for k in "ab")
    u = np.mean([(x < y) + 0.5 * (x == y) for x in a for y in b])
    assert one(ranking.auc(t, "a", "b"), "auc")["good"] == pytest.approx(max(u, 1 - u))


def test_erp_snr_prefers_the_channel_with_a_response(spark):
    rng = np.random.default_rng(5)
    bump = np.exp(-((np.arange(20) - 10) ** 2) / 8) * 2
    rows = [("r", c, i, k, float(v)) for c, gain in (("erp", 1.0), ("none", 0.0)) for i in range(41) for k, v in enumerate(rng.standard_normal(20) + gain * bump)]
    t = spark.createDataFrame(rows, "recording string, channel string, trial long, time long, value double")
    snr = one(ranking.erp_snr(t, 50), "erp_snr_db")
    assert snr["erp"] > 8 and abs(snr["none"]) < 5


@pytest.mark.parametrize("names,faults,seconds", [
    (TEN_TWENTY, {"T8": "noisy", "O2": "flat", "F7": "drift", "P4": "line", "C3": "pop"}, 90.0),
    (None, {"T8": "noisy", "O2": "flat", "F7": "drift", "P4": "line", "C3": "pop", "FC2": "disconnected", "CP5": "clipping", "AF3": "intermittent"}, 60.0),
])
def test_planted_faults_rank_lowest(spark, names, faults, seconds):
    """Exactly the faulty channels rank lowest, on 19 channels, where all others stay good, and on 64 with all kinds of faults."""
    if names is None:
        inner = [n for n, p in standard_positions().items() if p[2] > -0.05]
        names = sorted({*inner[:64], *faults})
    near = spatial.neighbours(spark.createDataFrame([(n, *map(float, standard_positions()[n])) for n in names], "channel string, x double, y double, z double"))
    table = quality.assess(simulate(spark, 1, names, seconds, 256.0, faults, seed=1), 256.0, 50.0, near).orderBy("rank").collect()
    assert {r.channel for r in table[-len(faults):]} == set(faults), [(r.channel, r.score, r.reasons) for r in table[-10:]]
    assert next(r for r in table if r.channel == "O2").grade == "bad"
    good = np.array([r.score for r in table if r.channel not in faults])
    assert np.median(good) >= 75 and (len(names) > 19 or good.min() >= 75), sorted(good)[:10]


def test_a_clean_recording_scores_high(spark):
    near = spatial.neighbours(spark.createDataFrame([(n, *map(float, standard_positions()[n])) for n in TEN_TWENTY], "channel string, x double, y double, z double"))
    clean = quality.assess(simulate(spark, 1, TEN_TWENTY, 60.0, 128.0, seed=7), 128.0, 50.0, near).toPandas()
    assert clean.score.median() > 90
    faults = {"T8": "noisy", "O2": "flat", "F7": "drift", "P4": "disconnected", "C3": "pop"}
    bad = bad_channels.find_bad_channels(simulate(spark, 1, TEN_TWENTY, 30.0, 128.0, faults, seed=1), 128.0).where("bad").toPandas()
    assert {"O2", "T8"} <= set(bad.channel)


def test_ransac_finds_a_channel_unlike_its_neighbours(spark):
    at = {n: p for n, p in standard_positions().items() if p[2] > -0.05}
    names = list(at)[:32]
    made = simulate(spark, 1, names, 20.0, 64.0, {names[7]: "noisy"}, seed=3)
    pool = made.select("recording", "channel").distinct()
    positions = pool.join(spark.createDataFrame([(n, *map(float, at[n])) for n in names], "channel string, x double, y double, z double"), "channel")
    found = one(bad_channels.ransac(made, pool, positions, 64.0), "ransac_bad_fraction")
    assert found[names[7]] == max(found.values()) and found[names[7]] > 0.4


def test_components_are_separated(spark):
    """Three signals of different distributions through a fixed mixture come back, up to sign and order."""
    rng, n = np.random.default_rng(16), 5000
    sources = np.stack([rng.uniform(-1, 1, n), rng.exponential(1.0, n), np.cos(np.cumsum(np.linspace(0.01, 0.4, n)))])
    x = np.array([[1.0, 0.5, -0.3], [-0.4, 1.0, 0.8], [0.6, -0.7, 1.0]]) @ sources
    s = frame(spark, a=x[0], b=x[1], c=x[2])
    model = ica.fit(s).cache()
    got = ica.sources(s, model).toPandas().pivot(index="sample", columns="channel", values="value").to_numpy().T
    match = np.abs(np.corrcoef(got, sources)[:3, 3:])
    assert sorted(match.argmax(axis=1)) == [0, 1, 2] and match.max(axis=1).min() > 0.97
    left = ica.remove(s, model, spark.createDataFrame([], "recording string, component int"))
    assert left.join(s.withColumnRenamed("value", "v"), ["recording", "channel", "sample"]).agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] < 1e-9
    none = ica.remove(s, model, model.select("recording", "component").distinct())
    assert none.groupBy("channel").agg(F.stddev("value").alias("s")).agg(F.max("s")).first()[0] < 1e-6


def test_pipeline(spark):
    s = frame(spark, a=np.arange(200.0), b=np.zeros(200))
    steps = "- step: reference\n- {step: filter, low: 1, high: 30}\n- {step: resample, sfreq: 50}\n- {step: pick, channels: [a]}\n"
    state = Pipeline.from_config(steps).run(s, 100.0)
    assert state.sfreq == 50 and state.samples.count() == 100 and len(state.history) == 4
    with pytest.raises(ValueError):
        Pipeline.from_config(["nothing"])


def test_stim_resampling_keeps_every_code(spark):
    x = np.zeros(100)
    x[10], x[50:53] = 4, 9
    y = filtering.resample_stim(frame(spark, s=x), 100, 25).orderBy("sample").toPandas().value.to_numpy()
    assert len(y) == 25 and y[2] == 4 and y[12] == 9 and (y > 0).sum() <= 3
    assert (filtering.resampled_codes(x, 0.25) == y).all()


def test_steps_go_by_type(spark):
    """Codes of a trigger channel stay codes, and a reference is made of EEG channels, and changes them alone."""
    rng = np.random.default_rng(9)
    code = np.zeros(400)
    code[100:110], code[200:203] = 5, 2
    s = frame(spark, Fz=rng.normal(0, 10, 400), Cz=rng.normal(0, 10, 400), Pz=np.full(400, 1e4), EOG=rng.normal(0, 90, 400), STI=code)
    steps = [{"set_bads": {"channels": ["Pz"]}}, {"filter": {"low": 1.0, "high": 40.0}}, {"notch": {"frequency": 50}}, {"notch": {}}, "reference"]
    state = Pipeline.from_config(steps).run(s, 200.0)
    wide = state.samples.toPandas().pivot(index="sample", columns="channel", values="value")
    assert (wide.STI.to_numpy() == code).all() and wide.EOG.std() > 40
    assert np.allclose(wide.Fz + wide.Cz, 0, atol=1e-6)
    halved = Pipeline.from_config([{"resample": {"sfreq": 100}}]).run(s, 200.0).samples.toPandas().pivot(index="sample", columns="channel", values="value")
    assert set(halved.STI) == {0, 2, 5} and (halved.STI == 5).sum() == 5 and len(halved) == 200
    one_less = Pipeline.from_config([{"reference": {"reference": "Cz", "drop": True}}]).run(s, 200.0)
    assert {r.channel for r in one_less.samples.select("channel").distinct().collect()} == {"Fz", "Pz", "EOG", "STI"} and one_less.channels.count() == 4


def test_names_that_clean_to_one_stay_apart(spark):
    s = frame(spark, **{"EEG Cz-REF": [1, 1], "Cz": [2, 2], "Pz.": [3, 3], "Cz-1": [4, 4]})
    state = Pipeline.from_config(["standardize_names"]).run(s, 100.0)
    names = {r.channel: r.value for r in state.samples.where("sample = 0").collect()}
    assert len(names) == 4 and names["Cz"] == 2 and names["Pz"] == 3 and set(names.values()) == {1, 2, 3, 4}


def test_bad_channels_with_positions_of_the_table(spark):
    at = {n: p for n, p in standard_positions().items() if p[2] > -0.05}
    names = sorted(at)[:34]
    made = simulate(spark, 1, names, 20.0, 64.0, {names[7]: "disconnected"}, seed=3)
    table = made.select("recording", "channel").distinct().join(spark.createDataFrame([(n, *map(float, at[n])) for n in names], "channel string, x double, y double, z double"), "channel")
    found = bad_channels.find_bad_channels(made, 64.0, table).toPandas().set_index("channel")
    assert found.ransac_bad_fraction.notna().all() and found.bad[names[7]]
    none = bad_channels.find_bad_channels(made, 64.0, table.limit(20)).toPandas()
    assert none.ransac_bad_fraction.isna().all()
