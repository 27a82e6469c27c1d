"""Ranges of files: filters on samples and times, and MATLAB 5 files with EEGLAB sets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from neurosheaf.operators import signals
from neurosheaf.sources import brainvision, edf, files, mat5, store

RNG = np.random.default_rng(0)
VALUES = {"Fp1": RNG.normal(0, 20, 4000), "Cz": np.cumsum(RNG.normal(0, 1, 4000)), "O1": np.linspace(-5, 5, 4000)}


def reader(path, *filters, **options):
    made = files.RecordingsReader({"path": str(path), "range_mb": "0.0005", **options})
    list(made.pushFilters(filters))
    return made


def rows(made):
    batches = [b for p in made.partitions() for b in made.read(p)]
    return pd.concat([b.to_pandas() for b in batches]) if batches else pd.DataFrame({"channel": [], "sample": [], "value": []})


@pytest.fixture(params=["edf", "brainvision", "matlab", "deflated"])
def folder(request, tmp_path):
    if request.param == "edf":
        store.write(f"{tmp_path}/a.edf", edf.encode(VALUES, 100.0, {}))
    elif request.param == "brainvision":
        for ending, data in brainvision.encode("a", VALUES, 100.0).items():
            store.write(f"{tmp_path}/a{ending}", data)
    else:
        made = [mat5.numbers("EEG", np.stack(list(VALUES.values()))), mat5.numbers("fs", np.array(100.0)), mat5.cells("labels", [mat5.text("", c) for c in VALUES])]
        store.write(f"{tmp_path}/a.mat", mat5.file(made, request.param == "deflated"))
    return tmp_path


@pytest.mark.parametrize(("filters", "first", "last"), [
    ((), 0, 4000), ((GreaterThanOrEqual(("sample",), 1000), LessThan(("sample",), 1200)), 1000, 1200), ((GreaterThan(("sample",), 3899),), 3900, 4000),
    ((LessThanOrEqual(("sample",), 99), EqualTo(("channel",), "Cz")), 0, 100), ((EqualTo(("sample",), 1234),), 1234, 1235), ((GreaterThan(("sample",), 9000),), 0, 0),
])
def test_filters_on_samples_reach_the_ranges(folder, monkeypatch, filters, first, last):
    read = [0]
    plain = store.read

    def counted(*a, **b):
        out = plain(*a, **b)
        read[0] += len(out)
        return out

    whole = len(reader(folder).partitions())
    made = reader(folder, *filters)
    parts = made.partitions()
    monkeypatch.setattr(store, "read", counted)
    got = rows(made)
    names = {"Cz"} if any(f.attribute == ("channel",) for f in filters) else set(VALUES)
    assert set(got.channel) == (names if last > first else set())
    for c, own in got.groupby("channel"):
        assert own["sample"].tolist() == list(range(first, last)) and np.abs(own.value.to_numpy() - VALUES[c][first:last]).max() < 0.01
    # A record or range more than the samples need, at most, on either side.
    assert len(parts) <= max(0 if last == first else 1, round(whole * (last - first) / 4000)) + 2
    if 0 < last - first <= 200 and not any(p.kind == "matlab" for p in parts):
        assert read[0] < 30_000 + 4 * 3 * 400


@pytest.mark.parametrize(("tmin", "tmax"), [(None, None), (3.0, 7.5), (38.0, None), (None, 0.5), (50.0, 60.0)])
def test_times_are_those_of_crop(spark, folder, tmin, tmax):
    options = {k: v for k, v in (("tmin", tmin), ("tmax", tmax)) if v is not None}
    got = files.read(spark, str(folder), **options).toPandas().sort_values(["channel", "sample"])
    want = signals.crop(files.read(spark, str(folder)), tmin or 0.0, 40.0 if tmax is None else tmax, 100.0).toPandas().sort_values(["channel", "sample"])
    assert got[["channel", "sample", "value"]].reset_index(drop=True).equals(want[["channel", "sample", "value"]].reset_index(drop=True))


def eeglab(trials, deflate, beside=None):
    x = np.arange(3 * 100 * trials, dtype=float).reshape(3, 100 * trials, order="F")
    empty = mat5.numbers("", np.zeros((0, 0)))
    events = [[mat5.numbers("", np.array(11.0)), mat5.text("", "stim"), mat5.numbers("", np.array(5.0))], [mat5.numbers("", np.array(151.0)), mat5.numbers("", np.array(7.0)), empty]]
    places = mat5.structs("", ["labels", "X"], [[mat5.text("", c), mat5.numbers("", np.array(1.0))] for c in ("Fz", "Cz", "Pz")])
    data = mat5.text("", beside) if beside else mat5._headed("", mat5.DOUBLE, (3, 100, trials), mat5.element(7, x.astype("<f4").tobytes(order="F")))
    number = lambda v: mat5.numbers("", np.array(float(v)))
    fields = {"srate": number(100), "nbchan": number(3), "pnts": number(100), "trials": number(trials), "data": data, "chanlocs": places, "event": mat5.structs("", ["latency", "type", "duration"], events)}
    return x, mat5.file([mat5.structs("EEG", list(fields), [list(fields.values())])], deflate)


@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("beside", [None, "other.fdt"])
def test_eeglab_sets(spark, tmp_path, deflate, beside):
    x, data = eeglab(4, deflate, beside)
    store.write(f"{tmp_path}/s.set", data)
    if beside:
        store.write(f"{tmp_path}/{beside}", x.astype("<f4").tobytes(order="F"))
    got = files.read(spark, str(tmp_path), range_mb=0.0002).toPandas().pivot(index="sample", columns="channel", values="value")
    assert (got[["Fz", "Cz", "Pz"]].to_numpy().T == x).all() and files.read(spark, str(tmp_path), range_mb=0.0002).rdd.getNumPartitions() > 3
    notes = [(r.onset, r.duration, r.description) for r in files.read(spark, str(tmp_path), "annotations").orderBy("onset").collect()]
    assert notes == [(0.1, 0.05, "stim"), (1.0, 0.0, "BAD boundary"), (1.5, 0.0, "7"), (2.0, 0.0, "BAD boundary"), (3.0, 0.0, "BAD boundary")]
    assert [(r.channel, r.sfreq, r.n_samples) for r in files.read(spark, str(tmp_path), "channels").orderBy("ch_index").collect()] == [("Fz", 100.0, 400), ("Cz", 100.0, 400), ("Pz", 100.0, 400)]


def test_forms_of_matrices(tmp_path):
    def load(*made, **options):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}.mat"
        store.write(path, mat5.file(list(made)))
        return mat5.recording(path, **options)

    x = np.arange(12.0).reshape(3, 4)
    r = load(mat5.numbers("signal", x.T), mat5.numbers("Fs", np.array(10.0)), mat5._headed("names", mat5.CHAR, (3, 2), mat5.element(17, np.array([ord(c) for c in "abcXYZ"], "<u2").tobytes())))
    assert r.channels == ["aX", "bY", "cZ"] and r.layout == "sc" and r.read(1, 3, [2])[2][1].tolist() == [9.0, 10.0]
    r = load(mat5.structs("rec", ["data", "srate"], [[mat5.numbers("", np.arange(20.0).reshape(2, 10)), mat5.numbers("", np.array(5.0))]]))
    assert r.channels == ["Ch1", "Ch2"] and r.sfreq == 5.0 and r.read(0, 10, [1])[1][1].tolist() == list(np.arange(10.0, 20.0))
    # Trials in front: names tell the channels.
    t = np.arange(2 * 3 * 5.0).reshape(2, 3, 5)
    r = load(mat5._headed("data", mat5.DOUBLE, t.shape, mat5.element(9, t.astype("<f8").tobytes(order="F"))), mat5.cells("ch_names", [mat5.text("", c) for c in "abc"]), mat5.cells("units", [mat5.text("", "mV")] * 3), sfreq=5.0)
    assert r.layout == "tcs" and np.array_equal(r.read(0, 10, [1])[1][1] / 1000, t[:, 1].ravel()) and np.array_equal(r.read(3, 7, [1])[1][1] / 1000, t[:, 1].ravel()[3:7])
    assert [a[2] for a in r.annotations] == ["trial", "BAD boundary", "trial"]
    for wrong in (b"MATLAB 5.0".ljust(200), mat5.file([mat5.text("data", "none")])):
        store.write(f"{tmp_path}/w.mat", wrong)
        with pytest.raises(ValueError):
            mat5.recording(f"{tmp_path}/w.mat")


def test_written_files_come_back(spark, tmp_path):
    samples = spark.createDataFrame(pd.concat(pd.DataFrame({"recording": "one", "channel": c, "sample": np.arange(4000), "value": x}) for c, x in VALUES.items()))
    marks = spark.createDataFrame([("one", 1.5, 0.0, "target"), ("one", 3.25, 0.5, "BAD blink")], files.SCHEMAS["annotations"])
    assert files.write(samples, str(tmp_path), 100.0, "matlab", marks).count() == 1
    got = files.read(spark, str(tmp_path), range_mb=0.02).toPandas()
    assert all((own.sort_values("sample").value.to_numpy() == VALUES[c]).all() for c, own in got.groupby("channel")) and len(got) == 12_000
    assert [(r.onset, r.duration, r.description) for r in files.read(spark, str(tmp_path), "annotations").orderBy("onset").collect()] == [(1.5, 0.0, "target"), (3.25, 0.5, "BAD blink")]
