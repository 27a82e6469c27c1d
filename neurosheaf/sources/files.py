"""Recordings as a Spark data source: ``spark.read.format("recordings").load(path)``.

The option ``table`` says what is read: samples (the default), channels or annotations. A file is read in
ranges of its records, each a task, so that one long recording is spread over many; text and numpy files
are a range each. Filters on ``channel`` and ``sample`` reach the reader, which then decodes no other signals and
plans no tasks for records outside.

Options: path (a file or a folder), table, sfreq, delimiter, unit, range_mb (size of a range, 16), tmin and tmax (seconds: only
samples in [tmin, tmax), counted from 0 again as signals.crop() does, whatever the rates of the files).
"""

from __future__ import annotations

import pickle
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import kept
from . import brainvision, edf, mat5, store, tables

#: Endings, and how files with them are read.
ENDINGS = {".edf": "edf", ".rec": "edf", ".bdf": "edf", ".vhdr": "brainvision", ".csv": "text", ".tsv": "text", ".txt": "text", ".asc": "text", ".npy": "numpy", ".npz": "numpy", ".mat": "matlab", ".set": "matlab"}
SCHEMAS = {
    "samples": "recording string, channel string, sample long, value double",
    "channels": "recording string, channel string, ch_index int, sfreq double, n_samples long",
    "annotations": "recording string, onset double, duration double, description string",
}


def supported() -> dict[str, str]:
    """Readers by ending."""
    return dict(ENDINGS)


def sniff(uri: str) -> str:
    """How a file is read: by its ending, else by its first bytes."""
    kind = ENDINGS.get(posixpath.splitext(uri)[1].lower())
    if kind:
        return kind
    head = store.read(uri, 0, 256)
    if head[:8] == b"\xffBIOSEMI" or (head[:8] == b"0       " and len(head) == 256):
        return "edf"
    if b"Brain Vision" in head or b"BrainVision" in head:
        return "brainvision"
    if head[:6] == b"MATLAB" and head[126:128] in (b"IM", b"MI"):
        return "matlab"
    if head[:6] == b"\x93NUMPY" or head[:2] == b"PK":
        return "numpy"
    head.decode("utf-8")
    return "text"


def name_of(uri: str) -> str:
    return posixpath.splitext(posixpath.basename(uri))[0]


@dataclass
class Range(InputPartition):
    uri: str
    kind: str
    first: int
    last: int


#: More files than these are read several a task, up to so many bytes of them; the tasks then look at their headers themselves.
FILES, PACK = 200, 1 << 21
#: Endings of files whose samples may lie in another one.
_BESIDE = (".vhdr", ".set")


@dataclass
class Pack(InputPartition):
    uris: list[str]


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "samples")]

    def reader(self, schema) -> RecordingsReader:
        return RecordingsReader(dict(self.options))

    def streamReader(self, schema) -> RecordingsStreamReader:
        return RecordingsStreamReader(dict(self.options))


class RecordingsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "samples")
        self.sfreq = float(options["sfreq"]) if options.get("sfreq") else None
        self.delimiter, self.unit = options.get("delimiter"), options.get("unit", "uV")
        self.size = int(float(options.get("range_mb", 16)) * 2**20)
        self.channels: set[str] | None = None
        # Samples from ``first`` to ``last`` - 1 are wanted, and of each file those of the times.
        self.first, self.last = 0, 1 << 62
        self.times = tuple(float(options[k]) if options.get(k) else None for k in ("tmin", "tmax"))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel",):
                self.channels = {f.value} & (self.channels or {f.value})
            elif isinstance(f, In) and f.attribute == ("channel",):
                self.channels = set(f.value) if self.channels is None else self.channels & set(f.value)
            elif getattr(f, "attribute", None) == ("sample",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
            yield f  # Spark checks it as well

    def _span(self, sfreq: float) -> tuple[int, int, int]:
        """First and last + 1 of the wanted samples of a signal, and what is taken from their numbers."""
        begin, end = (None if t is None else max(0, int(np.rint(t * sfreq))) for t in self.times)
        shift = begin or 0
        return max(self.first, 0) + shift, min(self.last + shift, 1 << 62 if end is None else end), shift

    def _records(self, spans: list[tuple[int, int, int]], n: int) -> tuple[int, int]:
        """The records (of so many samples) that hold any of the spans: (first, last, samples a record)."""
        held = [(a // size, -(-b // size)) for a, b, size in spans if a < b]
        return (max(0, min(a for a, _ in held)), min(n, max(b for _, b in held))) if held else (0, 0)

    def partitions(self) -> list[InputPartition]:
        found = store.sized(self.path, tuple(ENDINGS))
        out, small = [], []
        for uri, size in found:
            if len(found) > FILES and size <= PACK and not uri.lower().endswith(_BESIDE):
                small.append((uri, size))
            else:
                out += self._ranges([uri])
        held = PACK + 1
        for uri, size in small:
            if held + size > PACK:
                out.append(Pack([]))
                held = 0
            out[-1].uris.append(uri)
            held += size
        return out

    def _ranges(self, uris: list[str]) -> list[Range]:
        out = []
        for uri in uris:
            kind, n, step, begin = sniff(uri), 1, 1, 0
            samples = self.table == "samples"
            if kind == "edf":
                h = edf.header(uri)
                n, step = h.records, max(1, self.size // max(1, h.record_bytes))
                if samples:
                    own = [h.signals[i] for i in self._wanted([s["label"] for s in h.signals]) if i in h.data]
                    begin, n = self._records([(*self._span(s["n"] / h.seconds)[:2], s["n"]) for s in own], n)
            elif kind == "brainvision":
                h = brainvision.header(uri)
                if h.kind is not None:
                    n, step = h.samples, max(1, self.size // (np.dtype(h.kind).itemsize * len(h.channels)))
                    begin, n = self._records([(*self._span(h.sfreq)[:2], 1)], n) if samples else (0, n)
            elif kind == "matlab":
                h = mat5.recording(uri, self.sfreq)
                n, step = h.samples, max(1, self.size // h.bytes_a_sample)
                begin, n = self._records([(*self._span(h.sfreq)[:2], 1)], n) if samples else (0, n)
            if samples and begin >= n and kind in ("edf", "brainvision", "matlab"):
                continue
            if self.table == "channels" or (self.table == "annotations" and kind != "edf"):
                step = max(n, 1)
            out += [Range(uri, kind, a, min(a + step, n)) for a in range(begin, max(n, 1), step)]
        return out

    def _wanted(self, names: list[str]) -> list[int]:
        return [i for i, n in enumerate(names) if self.channels is None or n in self.channels]

    def _loaded(self, part: Range) -> dict:
        return tables.text(part.uri, self.sfreq, self.delimiter, self.unit) if part.kind == "text" else tables.archive(part.uri, self.sfreq)

    def read(self, part: InputPartition | None):
        if part is None:  # there are no ranges
            return
        if isinstance(part, Pack):
            for own in self._ranges(part.uris):
                yield from self.read(own)
            return
        recording = name_of(part.uri)
        rows = getattr(self, f"_{self.table}")(part, recording)
        if self.table == "samples":
            yield from rows
        else:
            yield from (tuple(r) for r in rows)

    def _samples(self, part: Range, recording: str):
        if part.kind == "edf":
            h = edf.header(part.uri)
            names, rates = [s["label"] for s in h.signals], [s["n"] / h.seconds for s in h.signals]
            found = edf.records(h, part.first, part.last, [i for i in self._wanted(names) if i in h.data])
        elif part.kind == "brainvision":
            h = brainvision.header(part.uri)
            names, rates = [c for c, _ in h.channels], [h.sfreq] * len(h.channels)
            found = brainvision.samples(h, part.first, part.last, self._wanted(names))
        elif part.kind == "matlab":
            h = mat5.recording(part.uri, self.sfreq)
            names, rates = h.channels, [h.sfreq] * len(h.channels)
            found = h.read(part.first, part.last, self._wanted(names))
        else:
            t = self._loaded(part)
            names, found, rates = t["channels"], {i: (0, t["values"][i]) for i in self._wanted(t["channels"])}, [float(t["sfreq"])] * len(t["channels"])
        for i, (start, values) in found.items():
            first, last, shift = self._span(rates[i])
            values = values[max(first - start, 0) : max(last - start, 0)]
            start = max(start, first) - shift
            n = len(values)
            one = lambda text: pa.array([text] * n, pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([one(recording), one(names[i]), pa.array(np.arange(start, start + n)), pa.array(values, pa.float64())], names=["recording", "channel", "sample", "value"])

    def _channels(self, part: Range, recording: str):
        if part.kind == "edf":
            h = edf.header(part.uri)
            return [(recording, h.signals[i]["label"], k, h.signals[i]["n"] / h.seconds, h.signals[i]["n"] * h.records) for k, i in enumerate(h.data)]
        if part.kind == "brainvision":
            h = brainvision.header(part.uri)
            n = h.samples if h.kind is not None else len(brainvision.samples(h, 0, 0, [0])[0][1])
            return [(recording, c, k, h.sfreq, n) for k, (c, _) in enumerate(h.channels)]
        if part.kind == "matlab":
            h = mat5.recording(part.uri, self.sfreq)
            return [(recording, c, k, h.sfreq, h.samples) for k, c in enumerate(h.channels)]
        t = self._loaded(part)
        return [(recording, c, k, float(t["sfreq"]), len(x)) for k, (c, x) in enumerate(zip(t["channels"], t["values"], strict=True))]

    def _annotations(self, part: Range, recording: str):
        if part.kind == "edf":
            h = edf.header(part.uri)
            first = edf.first_onset(h)
            return [(recording, o - first, d, t) for o, d, t in edf.annotations(h, part.first, part.last)]
        if part.kind == "matlab":
            found = mat5.recording(part.uri, self.sfreq).annotations
        else:
            found = brainvision.annotations(brainvision.header(part.uri)) if part.kind == "brainvision" else self._loaded(part)["annotations"]
        return [(recording, float(o), float(d), t) for o, d, t in found]


class RecordingsStreamReader(DataSourceStreamReader):
    """Samples of EDF, BDF and binary BrainVision files as they grow. An offset has the whole records of each file that were there; what
    stands behind the last whole one waits. Each trigger reads what is new, in ranges, of files that are new as well."""

    def __init__(self, options: dict[str, str]):
        if options.get("table", "samples") != "samples" or options.get("tmin") or options.get("tmax"):
            raise ValueError("a stream has samples, and all of them")
        self.batch = RecordingsReader(options)

    def initialOffset(self) -> dict:
        return {}

    def _there(self, uri: str) -> tuple[str, int, int]:
        """A file's kind, its whole records and their bytes."""
        kind = sniff(uri)
        if kind == "edf":
            h = edf.header(uri)
            return kind, h.records, h.record_bytes
        h = brainvision.header(uri) if kind == "brainvision" else None
        return (kind, h.samples, np.dtype(h.kind).itemsize * len(h.channels)) if h is not None and h.kind is not None else (kind, 0, 1)

    def latestOffset(self) -> dict:
        found = {}
        for uri in store.files(self.batch.path, tuple(ENDINGS)):
            try:
                found[uri] = self._there(uri)[1]
            except (ValueError, FileNotFoundError):  # a header that isn't whole yet
                continue
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for uri, n in sorted(end.items()):
            if n > start.get(uri, 0):
                kind, _, size = self._there(uri)
                step = max(1, self.batch.size // max(1, size))
                out += [Range(uri, kind, a, min(a + step, n)) for a in range(start.get(uri, 0), n, step)]
        return out

    def read(self, part: Range | None):
        return self.batch.read(part)


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The samples of the recordings in a folder as a stream."""
    spark.dataSource.register(Recordings)
    reader = spark.readStream.format("recordings")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def read(spark: SparkSession, path: str, table: str = "samples", **options) -> DataFrame:
    """A table of the recordings in a file or folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    reader = spark.read.format("recordings").option("table", table)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def bids_channels(spark: SparkSession, path: str, channels: DataFrame) -> DataFrame:
    """``channels`` with ch_type and bad from sidecar tables (name, type, status), matched by recording and name in any case.

    A sidecar belongs to the recording of its name with ``_channels`` in place of ``_eeg``.
    """
    side = spark.read.option("sep", "\t").option("header", True).csv(path).select("name", "type", "status", F.regexp_extract(F.input_file_name(), r"([^/]+)_channels\.tsv$", 1).alias("stem"))
    side = side.select(F.concat("stem", F.lit("_eeg")).alias("recording"), F.lower("name").alias("_name"), F.lower("type").alias("ch_type"), (F.lower("status") == "bad").alias("bad"))
    return channels.withColumn("_name", F.lower("channel")).join(side, ["recording", "_name"], "left").drop("_name")


#: Bytes of a recording's records that a task encodes at a time.
PART = 1 << 23


def write_records(samples: DataFrame, folder: str, sfreq: float, kind: str = "edf", annotations: DataFrame | None = None, part: int = PART) -> DataFrame:
    """Writes an EDF or BDF file a recording, of any length, into a folder that all executors reach: (recording, uri, bytes).

    Tasks encode ranges of records to parts in a folder of their own; then the parts of each recording are put together in order, behind
    its header, a piece at a time, and the file is moved to its place when it is whole. So a task that is lost or run again leaves no half
    file, and none holds a recording. What a channel lacks inside is written as 0, and behind its end as its last value; sample counts from 0.
    """
    spark, wide = samples.sparkSession, kind == "bdf"
    rows = samples.select(F.col("recording").cast("string").alias("recording"), "channel", F.col("sample").cast("long").alias("sample"), F.nanvl(F.coalesce(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"))
    if annotations is None:
        annotations = spark.createDataFrame([], SCHEMAS["annotations"])
    notes = annotations.select(F.col("recording").cast("string").alias("recording"), "onset", "duration", "description")
    ranges = rows.groupBy("recording", "channel").agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.max("sample") + 1).alias("n"), F.max_by("value", "sample").alias("last"))
    parts = f"{folder}/.parts-{uuid.uuid4().hex}"

    def planned(name: str, held: list[dict], marks: list[dict] | None) -> list[tuple]:
        texts = edf.mark_texts([(float(m["onset"]), float(m["duration"]), str(m["description"])) for m in marks or ()])
        most = max(r["n"] for r in held)
        # A channel that ends before others, or has gaps, has zeros or its last value there.
        own = edf.layout({r["channel"]: (min(r["low"], 0.0) if r["n"] < most else r["low"], max(r["high"], 0.0) if r["n"] < most else r["high"]) for r in held}, most, sfreq, texts, wide)
        per = max(1, part // own.record_bytes)
        plan, out = pickle.dumps((own, {r["channel"]: (r["n"], r["last"]) for r in held})), []
        for block, first in enumerate(range(0, own.count, per)):
            last = min(first + per, own.count)
            out.append((name, own.size, per, edf.header_bytes(own, dict.fromkeys(own.names, "uV")) if not block else None, plan, block, texts[own.listed(first)[0] : own.listed(last - 1)[1]]))
        return out

    # A row a recording, gone through in batches: groups of pandas so small would be dealt to a few tasks, and take most of the time.
    columns = pa.schema([("recording", pa.string()), ("size", pa.int64()), ("per", pa.int64()), ("head", pa.binary()), ("plan", pa.binary()), ("block", pa.int64()), ("texts", pa.list_(pa.binary()))])

    def plan_all(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = planned(row["recording"], row["held"], row["marks"])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), columns, strict=True)], schema=columns)

    held = ranges.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("channel", "low", "high", "n", "last"))).alias("held"))
    marks = notes.groupBy("recording").agg(F.collect_list(F.struct("onset", "duration", "description")).alias("marks"))
    plans = kept(held.join(marks, "recording", "left").select("recording", "held", "marks").mapInArrow(plan_all, "recording string, size long, per long, head binary, plan binary, block long, texts array<binary>"))
    sizes = plans.where("block = 0").select("recording", (F.col("size") * F.col("per")).alias("_span"))
    placed = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_RECORDINGS else sizes, "recording").withColumn("block", F.floor(F.col("sample") / F.col("_span"))).drop("_span")

    def encoded(held: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        (one,) = plan.itertuples()
        own, ends = pickle.loads(one.plan)
        first = one.block * one.per
        count = min(one.per, own.count - first)
        begin = first * own.size
        x = np.zeros((len(own.names), count * own.size))
        if len(held):
            x[np.searchsorted(own.names, held.channel.to_numpy(str)), held["sample"].to_numpy() - begin] = held.value.to_numpy()
        for row, name in zip(x, own.names, strict=True):
            n, last = ends[name]
            row[max(n - begin, 0) :] = last
        data = (one.head or b"") + edf.record_bytes(own, first, x, list(one.texts))
        # A recording of one part is its file.
        uri = f"{folder}/{one.recording}.{kind}" if own.count <= one.per else f"{parts}/{one.recording}/{one.block:09d}"
        store.write(uri, data)
        return pd.DataFrame({"recording": [one.recording], "block": [one.block], "uri": [uri], "bytes": [len(data)]})

    written = placed.groupBy("recording", "block").cogroup(plans.groupBy("recording", "block")).applyInPandas(encoded, "recording string, block long, uri string, bytes long")

    def joined(batches):
        for batch in batches:
            names, uris, totals = [], [], []
            for row in batch.to_pylist():
                names.append(row["recording"])
                uris.append(f"{folder}/{row['recording']}.{kind}")
                totals.append(sum(p["bytes"] for p in row["parts"]))
                own = [p["uri"] for p in row["parts"]]
                if own != uris[-1:]:
                    store.join(uris[-1], own, totals[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(uris, pa.string()), pa.array(totals, pa.int64())], names=["recording", "uri", "bytes"])

    gathered = written.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("block", "uri", "bytes"))).alias("parts"))
    return gathered.mapInArrow(joined, "recording string, uri string, bytes long")


#: Recordings whose record lengths are broadcast.
BROADCAST_RECORDINGS = 100_000


def write(samples: DataFrame, folder: str, sfreq: float, kind: str = "edf", annotations: DataFrame | None = None) -> DataFrame:
    """Writes a file a recording (edf, bdf, brainvision, text, numpy or matlab) into a folder that all executors reach: (recording, uri, bytes).

    EDF and BDF files are written in parts (see write_records); of the other kinds a recording has to fit a task. The files are written
    when the result is used; writing again gives the same files.
    """
    if kind in ("edf", "bdf"):
        return write_records(samples, folder, sfreq, kind, annotations)

    def encoded(name: str, values: dict, marks: list) -> dict[str, bytes]:
        if kind == "brainvision":
            return brainvision.encode(name, values, sfreq, marks)
        if kind == "matlab":
            return {".mat": mat5.encode(values, sfreq, marks)}
        return {".csv": tables.encode_text(values, sfreq, marks)} if kind == "text" else {".npz": tables.encode_archive(values, sfreq, marks)}

    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"recording": [], "uri": [], "bytes": []})
        name = str(rows.recording.iloc[0])
        wide = rows.pivot(index="sample", columns="channel", values="value").sort_index()
        marks = [(float(n.onset), float(n.duration), str(n.description)) for n in notes.itertuples()]
        out = []
        for ending, data in encoded(name, {c: wide[c].to_numpy(float) for c in wide.columns}, marks).items():
            store.write(f"{folder}/{name}{ending}", data)
            out.append((name, f"{folder}/{name}{ending}", len(data)))
        return pd.DataFrame(out, columns=["recording", "uri", "bytes"])

    rows = samples.select(F.col("recording").cast("string").alias("recording"), "channel", "sample", "value")
    if annotations is None:
        annotations = samples.sparkSession.createDataFrame([], SCHEMAS["annotations"])
    notes = annotations.select(F.col("recording").cast("string").alias("recording"), "onset", "duration", "description")
    return rows.groupBy("recording").cogroup(notes.groupBy("recording")).applyInPandas(run, "recording string, uri string, bytes long")
