import numpy as np
import pandas as pd

from neurosheaf.functions import filters
from neurosheaf.sources import edf, files
from neurosheaf.streaming import causal

SCHEMA = "recording string, channel string, sample long, value double"


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).toPandas()


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal(300)
    for k in range(3):
        rows = pd.DataFrame({"recording": "r", "channel": "a", "sample": np.arange(100 * k, 100 * k + 100), "value": x[100 * k : 100 * k + 100]})
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(spark, causal.causal_filter(stream, 1, 30, 100.0), "filtered").sort_values("sample")
    assert np.abs(got.value.to_numpy() - filters.causal(filters.butterworth(1, 30, 100.0), x)[0]).max() < 1e-9


def test_sessions_and_windows(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    seconds = [0, 1, 2, 30, 31, 200]
    rows = pd.DataFrame({"recording": "r", "channel": "a", "description": "x", "ts": [base + pd.Timedelta(seconds=s) for s in seconds], "value": [float(s) for s in seconds]})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    got = run(spark, causal.sessions(read, "ts", "10 seconds", "20 seconds"), "sessions").sort_values("start")
    assert list(got.n)[:2] == [3, 2]
    table = run(spark, causal.windowed_table(read, "ts", "60 seconds", "20 seconds"), "windows").sort_values("start")
    assert table.iloc[0].n == 5 and table.iloc[0].ptp == 31
    assert len(run(spark, causal.first_seen(read, ["description"], "ts", "20 seconds"), "firsts")) == 1


def step(spark, stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.read.parquet(f"{folder}/out").toPandas()


def test_files_that_grow_are_filtered_as_a_whole_after_a_restart(spark, tmp_path):
    x = {c: np.random.default_rng(i).standard_normal(1000) * 20 for i, c in enumerate("AB")}
    data = edf.encode(x, 100.0, {})
    h0 = 256 * 4
    size = (len(data) - h0) // 10
    data = data[:236] + b"-1      " + data[244:]  # as while it is recorded
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "r.edf"
    whole = None
    for k, end in enumerate((h0 + 3 * size + 17, h0 + 7 * size, len(data))):
        path.write_bytes(data[:end])
        if k == 2:
            (tmp_path / "in" / "new.edf").write_bytes(data)
        stream = files.read_stream(spark, str(tmp_path / "in"), range_mb=0.0005)
        whole = step(spark, causal.filter_events(stream, 1, 30, 100.0), tmp_path)
        assert (whole[whole.recording == "r"]["sample"].max() + 1) == (300, 700, 1000)[k]
    assert set(whole.event) == {"sample"} and len(whole) == 4000
    plain = files.read(spark, str(tmp_path / "in")).toPandas()
    for (r, c), own in plain.groupby(["recording", "channel"]):
        got = whole[(whole.recording == r) & (whole.channel == c)].sort_values("sample")
        want = filters.causal(filters.butterworth(1, 30, 100.0), own.sort_values("sample").value.to_numpy())[0]
        assert got["sample"].tolist() == list(range(1000)) and np.abs(got.value.to_numpy() - want).max() < 1e-9


class Handle:
    """What a processor asks of Spark, for one key."""

    def __init__(self):
        self.value, self.timers, self.now = None, [], 0

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    clear = lambda self: self.update(None)
    listTimers = lambda self: iter(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)
    getCurrentProcessingTimeInMs = lambda self: self.now

    def update(self, value):
        self.value = value


def test_late_rows_are_counted_and_idle_channels_end():
    sos, handle = filters.butterworth(1, 30, 100.0), Handle()
    own = causal._Filter(sos, 5000)
    own.init(handle)
    x = np.random.default_rng(2).standard_normal(100)
    put = lambda at: pd.concat(own.handleInputRows(("r", "a"), iter([pd.DataFrame({"sample": at, "value": x[at]})]), handle))
    first = put(np.arange(50)[::-1])
    handle.now = 3000
    second = put(np.arange(45, 60))
    assert handle.timers == [8000] and handle.value[0] == 59 and handle.value[2] == 5
    assert second[second.event == "late"].value.tolist() == [5.0] and set(first.event) == {"sample"}
    y = np.r_[first.value, second[second.event == "sample"].value]
    assert np.abs(y - filters.causal(sos, x[:60])[0]).max() < 1e-12
    (end,) = own.handleExpiredTimer(("r", "a"), handle, None)
    assert end[["event", "sample", "value"]].values.tolist() == [["end", 59, 5.0]] and handle.value is None
    assert put(np.arange(10)).event.tolist() == ["sample"] * 10
