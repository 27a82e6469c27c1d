"""Reports: what should be done with a recording, frames behind plots, and one HTML file from small tables."""

from __future__ import annotations

import html
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import montage

#: Colours of grades.
COLOURS = {"good": "#2a9d4b", "fair": "#e0a526", "poor": "#e0662b", "bad": "#c62828"}


def recommendations(assessed: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(recording, advice): from penalties over 3 for drift, noise and bad grades, and mains found."""
    size = lambda name: F.coalesce(F.try_element_at("penalties", F.lit(name)), F.lit(0.0))
    sums = assessed.groupBy("recording").agg(F.sort_array(F.collect_list(F.when(F.col("grade") == "bad", F.col("channel")))).alias("bad"), F.max(size("drift")).alias("drift"), F.median("drift_db").alias("level"), F.max(size("hf_noise")).alias("hf"))
    if lines is not None:
        sums = sums.join(lines, "recording", "left")
    else:
        sums = sums.withColumn("line", F.lit(None).cast("double"))
    advice = F.array(
        F.when(F.size("bad") > 0, F.concat(F.lit("interpolate bad channels: "), F.array_join("bad", ", "))),
        F.when(F.col("line").isNotNull(), F.format_string("notch filter at %.0f Hz", "line")),
        F.when((F.col("drift") > 3) | (F.col("level") > 6), F.lit("high-pass filter at 0.5 to 1 Hz")),
        F.when(F.col("hf") > 5, F.lit("check electrodes and muscle tension: high-frequency noise")),
    )
    return sums.select("recording", F.explode(F.filter(advice, lambda a: a.isNotNull())).alias("advice"))


def topomap_grid(values: dict[str, float], size: int = 32) -> list[tuple[float, float, float]]:
    """(x, y, value) on a grid over the head's circle, by spherical splines from channels with a standard position."""
    at = {n: p for n, p in montage.standard_positions().items() if n in values}
    axis = np.linspace(-1, 1, size)
    flat = np.array([(x, y) for y in axis for x in axis if x * x + y * y <= 1])
    r = np.hypot(*flat.T)
    theta = r * np.pi / 2
    ring = np.divide(np.sin(theta), r, out=np.full_like(r, np.pi / 2), where=r > 0)
    sphere = np.column_stack([flat * ring[:, None], np.cos(theta)])
    made = montage.spline_weights(np.array(list(at.values())), sphere) @ np.array([values[n] for n in at])
    return [(float(x), float(y), float(v)) for (x, y), v in zip(flat, made, strict=True)]


def erds_timecourse(trials: DataFrame, sfreq: float, base: tuple[int, int], smooth: float = 0.25) -> DataFrame:
    """(recording, channel, time, percent): change of the trials' mean square from the baseline, smoothed over a quarter of a second."""
    from pyspark.sql import Window as W

    half = max(0, round(smooth * sfreq / 2))
    squares = trials.groupBy("recording", "channel", "time").agg(F.avg(F.col("value") * F.col("value")).alias("p"))
    rest = F.avg(F.when(F.col("time").between(*base), F.col("p"))).over(W.partitionBy("recording", "channel"))
    near = F.avg("p").over(W.partitionBy("recording", "channel").orderBy("time").rowsBetween(-half, half))
    return squares.select("recording", "channel", "time", (100 * (near - rest) / F.nullif(rest, F.lit(0.0))).alias("percent"))


def to_json(assessed: DataFrame, path: str) -> None:
    """The quality table as JSON lines; missing values are left out."""
    assessed.write.json(path)


def page(recording: str, assessed: list[dict], advice: list[str]) -> str:
    """One recording's report; ``assessed`` are its rows of the quality table."""
    rows = sorted(assessed, key=lambda r: r["rank"])
    bars = "".join(f'<rect x="80" y="{18 * i}" width="{3 * r["score"]:.0f}" height="14" fill="{COLOURS[r["grade"]]}"/><text x="4" y="{18 * i + 12}">{html.escape(r["channel"])}</text><text x="{86 + 3 * r["score"]:.0f}" y="{18 * i + 12}">{r["score"]:.1f} {html.escape(", ".join(r["reasons"]))}</text>' for i, r in enumerate(rows))
    listed = "".join(f"<li>{html.escape(a)}</li>" for a in advice) or "<li>nothing to do</li>"
    head = f"<h1>{html.escape(recording)}</h1><p>{len(rows)} channels, median score {np.median([r['score'] for r in rows]):.1f}</p>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(recording)}</title></head><body>{head}<h2>Quality</h2><svg width="800" height="{18 * len(rows)}" font-size="12" font-family="sans-serif">{bars}</svg><h2>Recommendations</h2><ul>{listed}</ul><script type="application/json">{json.dumps([{k: r[k] for k in ("channel", "score", "grade", "rank")} for r in rows]).replace("<", "&lt;")}</script></body></html>'


def write_reports(assessed: DataFrame, advice: DataFrame, folder: str) -> DataFrame:
    """(recording, uri): a report for each recording, written by the tasks; a recording's rows are its channels."""
    import pandas as pd

    from ..sources import store

    listed = advice.groupBy("recording").agg(F.collect_list("advice").alias("advice"))
    ready = assessed.select("recording", "channel", "score", "grade", "rank", "reasons").join(listed, "recording", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name, own = str(rows.recording.iloc[0]), rows.advice.iloc[0]
        uri = f"{folder}/{name}.html"
        store.write(uri, page(name, rows.to_dict("records"), [] if own is None else list(own)).encode())
        return pd.DataFrame({"recording": [name], "uri": [uri]})

    return ready.groupBy("recording").applyInPandas(run, "recording string, uri string")
