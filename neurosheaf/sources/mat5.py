"""MATLAB 5 files and EEGLAB sets: nested elements, of which only what describes the data is read; the data matrix is read in ranges.

Elements have a tag (type, bytes) and hold values or further elements; a variable may be one deflated element. Parsing gives
places, so that a task reads its own part: from the file, or, of a deflated variable, by inflating up to it in small steps.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..functions.units import to_microvolts
from . import store

#: Fixed values of the format: numbers by the type of an element, and the kinds of matrices.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, DEFLATED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE, DOUBLE = 1, 2, 3, 4, 5, 6
#: Names under which files keep the rate, the data and the channels' names, in order of preference.
RATES = ("sfreq", "fs", "srate", "sampling_rate", "samplingrate", "sample_rate", "samplerate", "sampling_frequency", "samplingfrequency", "freq", "rate", "hz")
DATA = ("data", "eeg", "signals", "signal", "x", "raw", "samples", "y")
NAMES = ("ch_names", "channels", "labels", "channel_names", "chan_names", "chanlabels", "electrodes", "names", "clab", "channel_labels")
STEP = 1 << 20


class File:
    """A part of a file."""

    def __init__(self, uri: str, base: int = 0):
        self.uri, self.base = uri, base

    def read(self, at: int, n: int) -> bytes:
        return store.read(self.uri, self.base + at, n)


class Inflated:
    """What a deflated part of a file holds. Reading on goes on from where it stopped; reading before that begins anew. A step is held at a time."""

    def __init__(self, uri: str, base: int, size: int):
        self.uri, self.base, self.size = uri, base, size
        self._begin()

    def _begin(self) -> None:
        self.engine, self.fed, self.at, self.held = zlib.decompressobj(), 0, 0, b""

    def _more(self) -> bytes:
        raw = self.engine.unconsumed_tail
        if not raw and self.fed < self.size:
            raw = store.read(self.uri, self.base + self.fed, min(STEP, self.size - self.fed))
            self.fed += len(raw)
        return self.engine.decompress(raw, STEP) if raw else b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at:
            self._begin()
        parts, wanted = [], n
        while wanted:
            if at < self.at + len(self.held):
                part = self.held[at - self.at : at - self.at + wanted]
                parts.append(part)
                at, wanted = at + len(part), wanted - len(part)
            else:
                self.at += len(self.held)
                self.held = self._more()
                if not self.held and self.fed >= self.size and not self.engine.unconsumed_tail:
                    break
        return b"".join(parts)


@dataclass
class Matrix:
    """A matrix: numbers by their place, text, cells, or the fields of each element of a struct."""

    name: str
    kind: int
    dims: tuple[int, ...]
    source: File | Inflated | None = None
    at: int = 0
    number: str = "f8"
    text: list[str] = field(default_factory=list)
    cells: list[Matrix] = field(default_factory=list)
    elements: list[dict[str, Matrix]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return int(np.prod(self.dims))

    def numbers(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Numbers first to last - 1, by columns."""
        kind = np.dtype(self.number)
        last = self.size if last is None else last
        return np.frombuffer(self.source.read(self.at + first * kind.itemsize, (last - first) * kind.itemsize), kind).astype(float)

    def scalar(self) -> float | None:
        return float(self.numbers(0, 1)[0]) if self.kind >= DOUBLE and self.size else None

    def label(self) -> str:
        if self.kind == CHAR:
            return self.text[0].strip() if self.text else ""
        value = self.scalar()
        return "" if value is None else f"{value:g}"

    def labels(self) -> list[str] | None:
        """Names in a cell array, or the rows of a matrix of characters."""
        return [c.label() for c in self.cells] if self.kind == CELL else [t.strip() for t in self.text] if self.kind == CHAR else None


def _tag(source, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, bytes, where the values begin and where the next element does. Four bytes or fewer stand in the tag itself."""
    raw = source.read(at, 8)
    if len(raw) < 8:
        raise EOFError
    kind, n = struct.unpack(f"{order}II", raw)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, n, at + 8, at + 8 + (n if kind == DEFLATED else -(-n // 8) * 8)


def _values(source, at: int, order: str) -> tuple[np.ndarray, int]:
    kind, n, begin, after = _tag(source, at, order)
    return np.frombuffer(source.read(begin, n), np.dtype(NUMBERS[kind]).newbyteorder(order)), after


def _matrix(source, at: int, order: str) -> tuple[Matrix, int]:
    """The matrix whose element begins at a place, and where the next begins."""
    _, n, at, after = _tag(source, at, order)
    if not n:
        return Matrix("", DOUBLE, (0, 0)), after
    flags, at = _values(source, at, order)
    dims, at = _values(source, at, order)
    name, at = _values(source, at, order)
    found = Matrix(bytes(name).decode("latin-1"), int(flags[0]) & 0xFF, tuple(int(d) for d in dims))
    if found.kind == CHAR:
        kind, _, _, _ = _tag(source, at, order)
        codes, _ = _values(source, at, order)
        text = bytes(codes).decode("utf-8", "replace") if kind == 16 else "".join(map(chr, codes.tolist()))
        rows = found.dims[0] if found.dims else 0
        # By columns, as numbers are.
        found.text = ["".join(text[i::rows]) for i in range(rows)] if len(text) == found.size else [text]
    elif found.kind == CELL:
        for _ in range(found.size):
            cell, at = _matrix(source, at, order)
            found.cells.append(cell)
    elif found.kind in (STRUCT, OBJECT):
        if found.kind == OBJECT:
            _, at = _values(source, at, order)
        width, at = _values(source, at, order)
        raw, at = _values(source, at, order)
        step = int(width[0])
        fields = [bytes(raw[i : i + step]).split(b"\0")[0].decode("latin-1") for i in range(0, len(raw), step)]
        for _ in range(found.size):
            element = {}
            for f in fields:
                element[f], at = _matrix(source, at, order)
            found.elements.append(element)
    elif found.kind != SPARSE:
        kind, _, begin, _ = _tag(source, at, order)
        found.source, found.at, found.number = source, begin, np.dtype(NUMBERS[kind]).newbyteorder(order).str
    return found, after


def variables(uri: str) -> dict[str, Matrix]:
    """The variables of a file by name, in order."""
    head = store.read(uri, 0, 128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError(f"{uri}: not a MATLAB 5 file")
    order, at, size, out = "<" if head[126:128] == b"IM" else ">", 128, store.size(uri), {}
    whole = File(uri)
    while at + 8 <= size:
        kind, n, begin, after = _tag(whole, at, order)
        if kind == DEFLATED:
            found, _ = _matrix(Inflated(uri, begin, n), 0, order)
        elif kind == MATRIX:
            found, _ = _matrix(whole, at, order)
        else:
            found = None
        if found is not None and not found.name.startswith("__"):
            out[found.name] = found
        at = after
    return out


@dataclass
class Recording:
    """A file's data and what describes it. ``layout`` names the axes of the stored matrix, first the one that runs fastest."""

    data: Matrix
    layout: str  # of c (channels), s (samples) and t (trials)
    shape: dict[str, int]
    sfreq: float
    channels: list[str]
    gain: list[float]
    annotations: list[tuple[float, float, str]]

    @property
    def samples(self) -> int:
        return self.shape["s"] * self.shape.get("t", 1)

    @property
    def bytes_a_sample(self) -> int:
        return np.dtype(self.data.number).itemsize * len(self.channels)

    def read(self, first: int, last: int, wanted: list[int]) -> dict[int, tuple[int, np.ndarray]]:
        """For each wanted channel the first sample and the values of a range; trials follow one another."""
        n = len(self.channels)
        if self.layout in ("cs", "cst"):
            part = self.data.numbers(first * n, last * n).reshape(-1, n)
            return {i: (first, part[:, i] * self.gain[i]) for i in wanted}
        if self.layout == "sc":
            return {i: (first, self.data.numbers(i * self.samples + first, i * self.samples + last) * self.gain[i]) for i in wanted}
        # Trials run fastest: of each trial that the range touches, the samples from its first on.
        long, trials, found = self.shape["s"], self.shape["t"], {i: [] for i in wanted}
        for t in range(first // long, -(-last // long)):
            a, b = max(first - t * long, 0), min(last - t * long, long)
            part = self.data.numbers(a * n * trials, b * n * trials).reshape(b - a, n, trials)[:, :, t]
            for i in wanted:
                found[i].append(part[:, i] * self.gain[i])
        return {i: (first, np.concatenate(x)) for i, x in found.items()}


def _first(known: dict[str, Matrix], keys: tuple[str, ...]) -> Matrix | None:
    plain = {k.lower().replace(" ", "").replace("-", "_"): v for k, v in known.items()}
    return next((plain[k] for k in keys if k in plain), None)


def _laid_out(data: Matrix, names: list[str] | None) -> tuple[str, dict[str, int]]:
    """Channels are the axis that has as many places as there are names, else the shorter one."""
    dims = data.dims if len(data.dims) > 1 else (1, *data.dims)
    if len(dims) == 3:
        trials_first = dims[1] == len(names) if names else dims[0] > dims[1] and dims[2] > dims[1]
        layout = "tcs" if trials_first else "cst"
    else:
        by_channel = dims[0] == len(names) or (dims[1] != len(names) and dims[0] <= dims[1]) if names else dims[0] <= dims[1]
        layout = "cs" if by_channel else "sc"
    return layout, dict(zip(layout, dims, strict=True))


def _set(uri: str, eeg: dict[str, Matrix]) -> Recording:
    """An EEGLAB set. Its data may stand in a file of its own, single numbers by columns."""
    value = lambda key, otherwise: otherwise if key not in eeg or (v := eeg[key].scalar()) is None else v
    rate, n, points, trials = value("srate", None), int(value("nbchan", 0)), int(value("pnts", 0)), max(1, int(value("trials", 1)))
    data = eeg["data"]
    if data.kind == CHAR:
        beside = posixpath.join(posixpath.dirname(uri), posixpath.basename(data.label()))
        data = Matrix("data", 7, (n, points * trials), File(beside), 0, "<f4")
    trials = data.dims[2] if len(data.dims) == 3 else trials
    points = data.size // n // trials
    places = eeg["chanlocs"].elements if "chanlocs" in eeg else []
    names = [places[k]["labels"].label() if k < len(places) and "labels" in places[k] else "" for k in range(n)]
    marks = []
    for event in eeg["event"].elements if "event" in eeg else []:
        latency = event["latency"].scalar() if "latency" in event else None
        if latency is not None:
            lasts = (event["duration"].scalar() if "duration" in event else None) or 0.0
            marks.append(((latency - 1) / rate, lasts / rate, event["type"].label() if "type" in event else "event"))
    marks += [(k * points / rate, 0.0, "BAD boundary") for k in range(1, trials)]
    return Recording(data, "cst" if trials > 1 else "cs", {"c": n, "s": points, "t": trials}, rate, [x or f"Ch{k + 1}" for k, x in enumerate(names)], [1.0] * n, sorted(marks))


@lru_cache(8)
def recording(uri: str, sfreq: float | None = None) -> Recording:
    """What a file holds: an EEGLAB set, or the matrix, rate and names that it keeps under usual names, at the top or in a struct."""
    top = variables(uri)
    eeg = top.get("EEG")
    if eeg is not None and eeg.elements:
        return _set(uri, eeg.elements[0])
    if "srate" in top and "nbchan" in top:
        return _set(uri, top)
    known = dict(top)
    for v in top.values():
        for k, inner in v.elements[0].items() if len(v.elements) == 1 else ():
            known.setdefault(k, inner)
    numeric = lambda m: m is not None and m.kind >= DOUBLE and m.size > 1
    data = _first(known, DATA)
    if not numeric(data):
        data = max((m for m in known.values() if numeric(m)), key=lambda m: m.size, default=None)
    rate = sfreq or ((r := _first(known, RATES)) and r.scalar())
    if data is None or not rate:
        raise ValueError(f"{uri}: no {'matrix of numbers' if data is None else 'sampling rate'}")
    listed = _first(known, NAMES)
    names = listed.labels() if listed else None
    layout, shape = _laid_out(data, names)
    n = shape["c"]
    units = known["units"].labels() if "units" in known else None
    marks = []
    if "annot_onset" in top and top["annot_onset"].size:
        onsets, lasts = top["annot_onset"].numbers(), top["annot_duration"].numbers() if "annot_duration" in top else []
        texts = top["annot_description"].labels() or [] if "annot_description" in top else []
        marks = [(o, float(lasts[k]) if k < len(lasts) else 0.0, texts[k] if k < len(texts) else "") for k, o in enumerate(onsets.tolist())]
    if "t" in shape:
        marks += [(k * shape["s"] / rate, 0.0, "BAD boundary") for k in range(1, shape["t"])] + [(k * shape["s"] / rate, 0.0, "trial") for k in range(shape["t"])]
    gain = [to_microvolts(u) for u in units] if units and len(units) == n else [1.0] * n
    return Recording(data, layout, shape, float(rate), names if names and len(names) == n else [f"Ch{k + 1}" for k in range(n)], gain, sorted(marks))


# Writing


def element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _headed(name: str, kind: int, dims: tuple[int, ...], body: bytes) -> bytes:
    return element(MATRIX, element(6, struct.pack("<II", kind, 0)) + element(5, np.array(dims, "<i4").tobytes()) + element(1, name.encode("latin-1")) + body)


def numbers(name: str, x: np.ndarray) -> bytes:
    x = np.atleast_2d(np.asarray(x, "<f8"))
    return _headed(name, DOUBLE, x.shape, element(9, x.tobytes(order="F")))


def text(name: str, value: str) -> bytes:
    codes = np.array([ord(c) if ord(c) < 1 << 16 else 0xFFFD for c in value], "<u2")
    return _headed(name, CHAR, (1, len(codes)), element(17, codes.tobytes()))


def cells(name: str, made: list[bytes]) -> bytes:
    return _headed(name, CELL, (1, len(made)), b"".join(made))


def structs(name: str, fields: list[str], elements: list[list[bytes]]) -> bytes:
    """Elements give the matrices of their fields, without names, in order."""
    listed = b"".join(f.encode("latin-1")[:31].ljust(32, b"\0") for f in fields)
    return _headed(name, STRUCT, (1, len(elements)), element(5, struct.pack("<i", 32)) + element(1, listed) + b"".join(m for e in elements for m in e))


def file(made: list[bytes], deflate: bool = True) -> bytes:
    parts = [struct.pack("<II", DEFLATED, len(z)) + z for z in map(zlib.compress, made)] if deflate else made
    return b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts)


def encode(values: dict[str, np.ndarray], sfreq: float, marks: list[tuple[float, float, str]] = ()) -> bytes:
    """A file with data, sfreq, ch_names and annotations."""
    listed = sorted(marks)
    made = [numbers("data", np.stack([np.asarray(x, float) for x in values.values()])), numbers("sfreq", np.array(sfreq)), cells("ch_names", [text("", c) for c in values])]
    made += [numbers("annot_onset", np.array([m[0] for m in listed])), numbers("annot_duration", np.array([m[1] for m in listed])), cells("annot_description", [text("", m[2]) for m in listed])]
    return file(made)
