"""Simulated recordings with planted faults, one task a recording, the same for a seed however they are spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.montage import standard_positions

FAULTS = ("flat", "noisy", "drift", "line", "pop", "disconnected", "clipping", "intermittent")


def coloured(rng: np.random.Generator, n: int, sfreq: float, exponent: float = 1.6, knee: float = 1.0) -> np.ndarray:
    """Noise with a 1/f spectrum, of unit variance."""
    spectrum = np.fft.rfft(rng.standard_normal(n))
    x = np.fft.irfft(spectrum / np.sqrt(knee + np.fft.rfftfreq(n, 1 / sfreq) ** exponent), n)
    return x / x.std()


def broken(x: np.ndarray, fault: str, sfreq: float, line: float, rng: np.random.Generator) -> np.ndarray:
    """A channel with a fault."""
    n, t = len(x), np.arange(len(x)) / sfreq
    if fault == "flat":
        return rng.normal(0, 0.05, n)
    if fault == "noisy":
        return x + rng.normal(0, 60, n)
    if fault == "drift":
        return x + 400 * np.cumsum(rng.standard_normal(n)) / np.sqrt(n) + 150 * np.sin(2 * np.pi * 0.08 * t)
    if fault == "line":
        return x + 80 * np.sin(2 * np.pi * line * t)
    if fault == "pop":
        y = x.copy()
        for at in rng.integers(0, n, max(6, int(n / sfreq / 5))):
            y[at : at + int(0.25 * sfreq)] += rng.choice([-1, 1]) * rng.uniform(300, 700) * np.exp(-np.arange(len(y[at : at + int(0.25 * sfreq)])) / (0.05 * sfreq))
        return y
    if fault == "disconnected":
        return 30 * np.sin(2 * np.pi * line * t + rng.uniform(0, 6)) + rng.normal(0, 25, n)
    if fault == "clipping":
        limit = np.quantile(np.abs(x), 0.7)
        return np.clip(x, -limit, limit)
    y = x.copy()
    for at in range(0, n, int(6 * sfreq)):
        y[at : at + int(2 * sfreq)] = rng.normal(0, 90, len(y[at : at + int(2 * sfreq)]))
    return y


def recording(names: list[str], seconds: float, sfreq: float, faults: dict[str, str], line: float, seed: int) -> dict[str, np.ndarray]:
    """Background, alpha at the back, blinks at the front, mains and sensor noise, in microvolts; then the faults."""
    rng, n = np.random.default_rng(seed), int(seconds * sfreq)
    at = np.array([standard_positions()[c] for c in names])
    t = np.arange(n) / sfreq
    sources = rng.standard_normal((max(40, 2 * len(names)), 3))
    sources[:, 2] = np.abs(sources[:, 2])
    sources /= np.linalg.norm(sources, axis=1, keepdims=True)
    spread = lambda to: np.exp(-((np.arccos(np.clip(at @ np.atleast_2d(to).T, -1, 1)) / 0.8) ** 2))
    x = spread(sources) @ np.stack([coloured(rng, n, sfreq) for _ in sources])
    x *= 10 / x.std()
    slow = 1 + 0.5 * np.sin(2 * np.pi * 0.1 * t + rng.uniform(0, 6))
    x += 12 * spread(np.array([0.0, -0.87, 0.5])) * slow * np.sin(2 * np.pi * rng.uniform(9.5, 10.5) * t)
    blink = np.zeros(n)
    for onset in np.arange(2, seconds - 1, 4) + rng.uniform(-1, 1, len(np.arange(2, seconds - 1, 4))):
        blink += rng.uniform(90, 160) * np.exp(-(((t - onset) / 0.08) ** 2))
    x += np.exp(-((np.arccos(np.clip(at @ np.array([0.0, 0.98, 0.2]), -1, 1)) / 0.5) ** 2))[:, None] * blink
    x += 1.5 * rng.uniform(0.5, 1.5, (len(names), 1)) * np.sin(2 * np.pi * line * t) + rng.normal(0, 0.5, x.shape)
    return {c: broken(row, faults[c], sfreq, line, rng) if c in faults else row for c, row in zip(names, x, strict=True)}


def simulate(spark: SparkSession, recordings: int, names: list[str], seconds: float = 60.0, sfreq: float = 256.0, faults: dict[str, str] | None = None, line: float = 50.0, seed: int = 0) -> DataFrame:
    """Samples of ``recordings`` recordings named r000000, ...; recording i has the seed ``seed`` + i."""
    wrong = set((faults or {}).values()) - set(FAULTS)
    if wrong:
        raise ValueError(f"unknown faults: {sorted(wrong)}")

    def run(frames):
        for f in frames:
            for i in f.id:
                for c, x in recording(names, seconds, sfreq, faults or {}, line, seed + int(i)).items():
                    yield pd.DataFrame({"recording": f"r{int(i):06d}", "channel": c, "sample": np.arange(len(x)), "value": x})

    return spark.range(recordings).repartition(max(1, min(recordings, 10_000)), F.col("id")).mapInPandas(run, "recording string, channel string, sample long, value double")
