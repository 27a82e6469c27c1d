"""Commands: ``python -m neurosheaf.cli COMMAND ...``; a path is a file or a folder of recordings."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import features, quality, ranking
from .plans.pipeline import Pipeline
from .plans.report import recommendations, write_reports
from .session import kept, ship
from .sources import files
from .sources.simulate import simulate


def _rate(spark, path: str) -> float:
    """The one sampling rate of a path's recordings."""
    rates = [r.sfreq for r in files.read(spark, path, "channels").select("sfreq").distinct().limit(2).collect()]
    if len(rates) != 1:
        raise ValueError("recordings of one sampling rate are needed; resample them first")
    return rates[0]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="neurosheaf")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "quality", "rank", "process", "report", "features", "convert"):
        c = sub.add_parser(name)
        c.add_argument("path")
        if name in ("process", "report", "convert"):
            c.add_argument("out")
        if name == "rank":
            c.add_argument("--by", default="quality")
        if name == "process":
            c.add_argument("--config", required=True)
        if name in ("process", "convert"):
            c.add_argument("--format", default="edf", choices=["edf", "bdf", "brainvision", "text", "numpy"])
        if name in ("quality", "rank", "report"):
            c.add_argument("--line", type=float)
    sub.add_parser("formats")
    c = sub.add_parser("simulate")
    c.add_argument("out")
    c.add_argument("--recordings", type=int, default=1)
    c.add_argument("--seconds", type=float, default=60.0)
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    a = _parser().parse_args(argv)
    ship(spark)
    if a.command == "formats":
        print("\n".join(f"{e}\t{k}" for e, k in sorted(files.supported().items())))
        return
    if a.command == "simulate":
        made = simulate(spark, a.recordings, ["Fp1", "Fp2", "F3", "F4", "C3", "Cz", "C4", "P3", "P4", "O1", "O2"], a.seconds)
        files.write(made, a.out, 256.0).show(truncate=False)
        return
    if a.command == "info":
        files.read(spark, a.path, "channels").orderBy("recording", "ch_index").show(1000, truncate=False)
        return
    sfreq, samples = _rate(spark, a.path), files.read(spark, a.path)
    if a.command == "quality":
        quality.assess(samples, sfreq, a.line).select("recording", "rank", "channel", "score", "grade", "reasons").orderBy("recording", "rank").show(1000, truncate=False)
    elif a.command == "rank":
        ranking.rank_channels(samples, sfreq, a.by, a.line).orderBy("recording", "rank").show(1000, truncate=False)
    elif a.command == "features":
        features.time_features(samples, sfreq).orderBy("recording", "channel").show(1000, truncate=False)
    elif a.command == "report":
        assessed = kept(quality.assess(samples, sfreq, a.line))
        write_reports(assessed, recommendations(assessed), a.out).show(truncate=False)
    elif a.command == "convert":
        files.write(samples, a.out, sfreq, a.format, files.read(spark, a.path, "annotations")).show(truncate=False)
    else:
        with open(a.config, encoding="utf-8") as f:
            state = Pipeline.from_config(f.read()).run(samples, sfreq)
        files.write(state.samples, a.out, state.sfreq, a.format, state.annotations).show(truncate=False)


def main() -> int:
    try:
        run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
