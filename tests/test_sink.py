"""EDF files written in parts by many tasks."""

import os

import numpy as np
import pandas as pd
import pytest

from neurosheaf.sources import edf, files, store


def recordings(spark, n=8000, short=5000):
    rng = np.random.default_rng(0)
    parts = []
    for name in ("one", "two"):
        parts += [pd.DataFrame({"recording": name, "channel": c, "sample": np.arange(n if c != "Short" else short), "value": rng.normal(5, 20, n if c != "Short" else short)}) for c in ("Cz", "Fp1", "Short")]
    return pd.concat(parts), spark.createDataFrame(pd.concat(parts))


@pytest.mark.parametrize("kind", ["edf", "bdf"])
def test_a_recording_of_many_tasks_comes_back(spark, tmp_path, kind):
    table, samples = recordings(spark)
    marks = [("one", i * 0.37, 0.1 * (i % 3), f"mark {i}") for i in range(120)]
    notes = spark.createDataFrame(marks, files.SCHEMAS["annotations"])
    out = files.write_records(samples, str(tmp_path), 100.0, kind, notes, part=1).collect()
    assert {r.recording: r.bytes for r in out} == {r: os.path.getsize(f"{tmp_path}/{r}.{kind}") for r in ("one", "two")}
    assert edf.header(f"{tmp_path}/one.{kind}").records == 80
    # The same bytes as in one piece, but that what lies behind a channel's end is its last value in both.
    for name in ("one", "two"):
        own = table[table.recording == name]
        values = {c: g.value.to_numpy() for c, g in own.groupby("channel")}
        whole = {c: np.pad(v, (0, 8000 - len(v)), "edge") for c, v in values.items()}
        got = files.read(spark, f"{tmp_path}/{name}.{kind}").toPandas()
        for c, v in whole.items():
            assert np.abs(got[got.channel == c].sort_values("sample").value.to_numpy() - v).max() < (0.01 if kind == "edf" else 1e-4)
    got = sorted((round(r.onset, 6), round(r.duration, 6), r.description) for r in files.read(spark, f"{tmp_path}/one.{kind}", "annotations").collect())
    assert got == sorted((round(o, 6), round(d, 6), t) for _, o, d, t in marks)
    assert not [f for d, _, names in os.walk(tmp_path) for f in names if not f.endswith(kind)]


def test_parts_give_the_bytes_of_one_piece(spark, tmp_path):
    _, samples = recordings(spark, 3000, 3000)
    files.write_records(samples, f"{tmp_path}/a", 100.0, part=1).collect()
    files.write_records(samples, f"{tmp_path}/b", 100.0).collect()
    wide = samples.where("recording = 'one'").toPandas().pivot(index="sample", columns="channel", values="value")
    whole = edf.encode({c: wide[c].to_numpy() for c in wide.columns}, 100.0, {})
    assert store.read(f"{tmp_path}/a/one.edf") == store.read(f"{tmp_path}/b/one.edf") == whole


def test_no_half_file_is_left(tmp_path):
    for i in range(3):
        store.write(f"{tmp_path}/p/{i}", bytes([i]) * 10)
    parts = [f"{tmp_path}/p/{i}" for i in range(3)]
    with pytest.raises(OSError):
        store.join(f"{tmp_path}/x.edf", parts, 31)
    assert not os.path.exists(f"{tmp_path}/x.edf") and os.path.exists(parts[0])
    store.join(f"{tmp_path}/x.edf", parts, 30)
    store.join(f"{tmp_path}/x.edf", parts, 30)  # a task that is run again
    assert os.path.getsize(f"{tmp_path}/x.edf") == 30 and not os.path.exists(parts[0])
    with pytest.raises(FileNotFoundError):
        store.join(f"{tmp_path}/y.edf", parts, 30)


@pytest.mark.parametrize(("rate", "n"), [(30.0, 601), (7.0, 50), (128.0, 999)])
def test_records_whose_times_have_many_digits(spark, tmp_path, rate, n):
    x = np.sin(np.arange(n) / 5)
    rows = spark.createDataFrame(pd.DataFrame({"recording": "r", "channel": "A", "sample": np.arange(n), "value": x}))
    files.write_records(rows, str(tmp_path), rate, part=1).collect()
    assert store.read(f"{tmp_path}/r.edf") == edf.encode({"A": x}, rate, {})


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([("r", "A", 0, 1.0), ("r", "A", 1, None), ("r", "A", 2, float("nan")), ("r", "A", 4, 3.0), ("r", "B", 2, 7.0)], "recording string, channel string, sample long, value double")
    (out,) = files.write_records(rows, str(tmp_path), 5.0).collect()
    got = files.read(spark, out.uri).toPandas().pivot(index="sample", columns="channel", values="value").to_numpy().T
    assert np.abs(got - [[1, 0, 0, 0, 3], [0, 0, 7, 7, 7]]).max() < 0.01
    assert files.write_records(rows.limit(0), f"{tmp_path}/none", 5.0).count() == 0
