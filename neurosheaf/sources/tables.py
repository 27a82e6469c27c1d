"""Recordings in delimited text and in numpy archives."""

from __future__ import annotations

import io
import re

import numpy as np

from ..functions.units import to_microvolts
from . import store

#: Names of columns that aren't signals.
TIME_NAMES = re.compile(r"(?i)^\s*(time|t|seconds?|timestamps?|times?\s*\(?m?s\)?)\s*(\(.*\)|\[.*\])?\s*$")
INDEX_NAMES = re.compile(r"(?i)^\s*(index|sample|sample index|sample_index|samples|#|)\s*$")
MARK_NAMES = re.compile(r"(?i)^\s*(markers?|events?|triggers?|annotations?|labels?)\s*$")
_RATE = re.compile(r"(?i)(?:sfreq|sample rate|sampling rate)\s*[:=]\s*([0-9.]+)")


def filled(x: np.ndarray) -> np.ndarray:
    """Gaps filled on a straight line, the ends with the nearest value; without any value: zeros."""
    known = np.flatnonzero(np.isfinite(x))
    return np.zeros_like(x) if not len(known) else np.interp(np.arange(len(x)), known, x[known])


def _numbers(cells: list[str]) -> np.ndarray:
    out = np.full(len(cells), np.nan)
    for i, c in enumerate(cells):
        try:
            out[i] = float(c)
        except ValueError:
            pass
    return out


def text(uri: str, sfreq: float | None = None, delimiter: str | None = None, unit: str = "uV") -> dict:
    """channels, sfreq, values and annotations of a delimited file: one row a sample, or one row a channel if the first cells are names.

    The rate is given, in a comment line, or from a column of times. Columns that are mostly no numbers are left out.
    """
    lines = store.read(uri).decode("utf-8", "replace").splitlines()
    comments = [x for x in lines if re.match(r"\s*(#|%|//)", x)]
    body = [x for x in lines if x.strip() and not re.match(r"\s*(#|%|//)", x)]
    delimiter = delimiter or max(",\t;", key=lambda c: body[0].count(c))
    split = lambda x: [c.strip() for c in (x.split(delimiter) if delimiter in body[0] else x.split())]
    rows = [split(x) for x in body]
    numeric = np.isfinite(_numbers(rows[0]))
    for c in comments:
        if sfreq is None and (m := _RATE.search(c)):
            sfreq = float(m[1])
    if len(rows[0]) > 2 and not numeric[0] and numeric[1:].all():
        names, columns = [r[0] for r in rows], [_numbers(r[1:]) for r in rows]
        return _table(uri, names, columns, sfreq, unit, [])
    names = [f"Ch{i + 1}" for i in range(len(rows[0]))]
    if numeric.mean() < 0.5:
        names, rows = rows[0], rows[1:]
    marks, channels, columns = [], [], []
    for i, name in enumerate(names):
        cells = [r[i] if i < len(r) else "" for r in rows]
        x = _numbers(cells)
        if MARK_NAMES.match(name):
            marks = [(k, part) for k, c in enumerate(cells) for part in c.split("|") if part and part not in ("0", "0.0", "nan")]
        elif TIME_NAMES.match(name):
            step = float(np.nanmedian(np.diff(x))) if len(x) > 1 else np.nan
            step = step / 1000 if "ms" in name.lower() or ("timestamp" in name.lower() and step > 1) else step
            if sfreq is None and step > 0:
                sfreq = round(1 / step, 6)
        elif not INDEX_NAMES.match(name) and np.isfinite(x).mean() > 0.5:
            channels.append(name)
            columns.append(x)
    return _table(uri, channels, columns, sfreq, unit, marks)


def _table(uri: str, channels: list[str], columns: list[np.ndarray], sfreq: float | None, unit: str, marks: list[tuple[int, str]]) -> dict:
    if not sfreq:
        raise ValueError(f"{uri}: the sampling rate has to be given")
    scale = to_microvolts(unit)
    return {"channels": channels, "sfreq": sfreq, "values": [filled(x) * scale for x in columns], "annotations": [(k / sfreq, 0.0, t) for k, t in marks]}


def encode_text(values: dict[str, np.ndarray], sfreq: float, marks: list[tuple[float, float, str]] = ()) -> bytes:
    """A comma-separated table with a line for the rate and, if there are annotations, a column for them."""
    at: dict[int, list[str]] = {}
    for onset, _, label in sorted(marks):
        at.setdefault(round(onset * sfreq), []).append(label.replace(",", " ").replace("|", " "))
    out = [f"# sfreq: {sfreq:.10g}", ",".join([*values, *(["marker"] if at else [])])]
    for i, row in enumerate(zip(*values.values(), strict=True)):
        out.append(",".join([*(f"{v:.7g}" for v in row), *(["|".join(at.get(i, []))] if at else [])]))
    return ("\n".join(out) + "\n").encode()


def archive(uri: str, sfreq: float | None = None) -> dict:
    """A numpy file: a matrix with channels in the smaller dimension; an archive may name data, sfreq, ch_names and annotations."""
    loaded = np.load(io.BytesIO(store.read(uri)), allow_pickle=False)
    if isinstance(loaded, np.ndarray):
        data, names, marks = loaded, None, []
    else:
        key = next((k for k in ("data", "eeg", "X", "x", "signal", "signals") if k in loaded), loaded.files[0])
        data = loaded[key]
        names = next(([str(n) for n in loaded[k]] for k in ("ch_names", "channels", "labels") if k in loaded), None)
        sfreq = sfreq or next((float(loaded[k]) for k in ("sfreq", "fs", "srate") if k in loaded), None)
        marks = list(zip(loaded["onset"].tolist(), loaded["duration"].tolist(), loaded["description"].tolist(), strict=True)) if "onset" in loaded else []
    data = np.atleast_2d(np.asarray(data, float))
    if data.ndim == 3:
        data = data.transpose(1, 0, 2).reshape(data.shape[1], -1)
    if (len(names) != len(data) and len(names) == data.shape[1]) if names else data.shape[0] > data.shape[1]:
        data = data.T
    names = names or [f"Ch{i + 1}" for i in range(len(data))]
    return _table(uri, names, list(data), sfreq, "uV", []) | {"annotations": marks}


def encode_archive(values: dict[str, np.ndarray], sfreq: float, marks: list[tuple[float, float, str]] = ()) -> bytes:
    out = io.BytesIO()
    o, d, t = zip(*sorted(marks), strict=True) if marks else ((), (), ())
    np.savez_compressed(out, data=np.stack(list(values.values())), sfreq=sfreq, ch_names=np.array(list(values)), onset=np.array(o, float), duration=np.array(d, float), description=np.array(t, str))
    return out.getvalue()
