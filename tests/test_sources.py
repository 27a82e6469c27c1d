import numpy as np
import pandas as pd
import pytest

from neurosheaf.sources import brainvision, edf, files, store, tables

SCHEMA = "recording string, channel string, sample long, value double"


@pytest.fixture
def recording(spark):
    rng = np.random.default_rng(0)
    values = {"Fp1": rng.normal(0, 20, 2560), "Cz": np.cumsum(rng.normal(0, 1, 2560)), "O1": np.full(2560, 3.0)}
    rows = pd.concat(pd.DataFrame({"recording": "one", "channel": c, "sample": np.arange(2560), "value": x}) for c, x in values.items())
    marks = spark.createDataFrame([("one", 1.5, 0.0, "target"), ("one", 3.25, 0.5, "BAD blink")], files.SCHEMAS["annotations"])
    return values, spark.createDataFrame(rows, SCHEMA), marks


@pytest.mark.parametrize(("kind", "close"), [("edf", 0.01), ("bdf", 1e-4), ("brainvision", 1e-4), ("text", 1e-4), ("numpy", 1e-12)])
def test_round_trip(spark, tmp_path, recording, kind, close):
    values, samples, marks = recording
    assert files.write(samples, str(tmp_path), 256.0, kind, marks).count() >= 1
    got = files.read(spark, str(tmp_path), range_mb=0.002).toPandas()
    for c, x in values.items():
        y = got[got.channel == c].sort_values("sample")
        assert list(y["sample"]) == list(range(2560)) and np.abs(y.value.to_numpy() - x).max() < close, c
    table = files.read(spark, str(tmp_path), "channels").orderBy("ch_index").collect()
    assert len(table) == 3 and all(r.sfreq == 256 and r.n_samples == 2560 for r in table)
    notes = files.read(spark, str(tmp_path), "annotations").orderBy("onset").collect()
    assert [(r.onset, r.description) for r in notes] == [(1.5, "target"), (3.25, "BAD blink")]
    if kind not in ("text",):
        assert notes[1].duration == 0.5
    one = files.read(spark, str(tmp_path)).where("channel = 'Cz'")
    assert one.count() == 2560 and one.select("channel").distinct().count() == 1


def test_edf_header_of_odd_files(tmp_path):
    x = {"Cz": np.arange(100.0), "SpO2": np.arange(100.0)}
    data = bytearray(edf.encode(x, 100.0, {"Cz": "mV"}, patient="P 1"))
    data[236:244] = b"999     "
    path = f"{tmp_path}/a.edf"
    store.write(path, bytes(data))
    h = edf.header(path)
    assert h.records == 1 and h.began is None and [h.signals[i]["label"] for i in h.data] == ["Cz", "SpO2"]
    got = edf.records(h, 0, 1, [0])
    assert np.abs(got[0][1] / 1000 - x["Cz"]).max() < 0.01
    store.write(f"{tmp_path}/short.edf", b"0")
    with pytest.raises(ValueError):
        edf.header(f"{tmp_path}/short.edf")
    assert edf.began("02.03.85", "10.11.12", "").year == 1985 and edf.began("02.03.84", "10.11.12", "").year == 2084
    assert edf.began("02.03.02", "10.11.12", "Startdate 02-MAR-1902 X").year == 1902 and edf.began("x", "", "") is None


def test_many_annotations(spark, tmp_path):
    x = {"a": np.arange(500.0)}
    marks = [(i * 0.02, 0.0, f"mark {i}") for i in range(200)]
    store.write(f"{tmp_path}/m.edf", edf.encode(x, 100.0, {}, marks=marks))
    got = sorted((r.onset, r.description) for r in files.read(spark, f"{tmp_path}/m.edf", "annotations").collect())
    assert len(got) == 200 and got[7] == (0.14, "mark 7")


def test_three_byte_numbers():
    raw = np.array([[1, 0, 0, 255, 255, 255, 0, 0, 128]], np.uint8)
    assert edf.integers(raw, 3).tolist() == [[1, -1, -(1 << 23)]]


def test_text_forms(tmp_path):
    def load(text, **options):
        store.write(f"{tmp_path}/t.csv", text.encode())
        return tables.text(f"{tmp_path}/t.csv", **options)

    t = load("time,Fp1,Cz,marker\n" + "\n".join(f"{i / 250},{i},{-i},{'go' if i == 100 else ''}" for i in range(500)))
    assert t["sfreq"] == 250 and t["channels"] == ["Fp1", "Cz"] and t["annotations"] == [(0.4, 0.0, "go")]
    t = load("\n".join(f"{i}\t{i}\t{i}" for i in range(300)), sfreq=100.0)
    assert t["channels"] == ["Ch1", "Ch2", "Ch3"]
    t = load("%Sample Rate = 250 Hz\nSample Index, EXG Channel 0, EXG Channel 1, Timestamp (Formatted)\n" + "\n".join(f"{i}, {i}, {i}, 2020-01-01 {i}" for i in range(10)))
    assert t["sfreq"] == 250 and t["channels"] == ["EXG Channel 0", "EXG Channel 1"]
    t = load("Cz,1,2,3\nPz,4,5,6", sfreq=10.0, unit="V")
    assert t["channels"] == ["Cz", "Pz"] and t["values"][1].tolist() == [4e6, 5e6, 6e6]
    t = load("Cz,Pz\n1,2\n,3\n3,4", sfreq=10.0)
    assert t["values"][0].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        load("a,b\n1,2\n3,4")


def test_brainvision_text(tmp_path):
    store.write(f"{tmp_path}/a.vhdr", b"Brain Vision\n[Common Infos]\nDataFile=a.dat\nDataFormat=ASCII\nDataOrientation=MULTIPLEXED\nSamplingInterval=4000\n[Channel Infos]\nCh1=C\\1z,,0.5,uV\nCh2=Pz,,1,mV\n")
    store.write(f"{tmp_path}/a.dat", b"Cz Pz\n1 2\n3 4\n5,5 6\n7 8\n")
    h = brainvision.header(f"{tmp_path}/a.vhdr")
    got = brainvision.samples(h, 0, 0, [0, 1])
    assert h.sfreq == 250 and h.channels[0][0] == "C,z" and got[0][1].tolist() == [0.5, 1.5, 2.75, 3.5] and got[1][1][0] == 2000


def test_sidecar(spark, tmp_path):
    store.write(f"{tmp_path}/s1_channels.tsv", b"name\ttype\tunits\tstatus\ncz\tEEG\tuV\tgood\nVEOG\tEOG\tuV\tbad\n")
    channels = spark.createDataFrame([("s1_eeg", "Cz"), ("s1_eeg", "VEOG"), ("s1_eeg", "x")], "recording string, channel string")
    got = {r.channel: (r.ch_type, r.bad) for r in files.bids_channels(spark, f"{tmp_path}/s1_channels.tsv", channels).collect()}
    assert got == {"Cz": ("eeg", False), "VEOG": ("eog", True), "x": (None, None)}
