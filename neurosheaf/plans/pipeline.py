"""Pipelines of steps over recordings, from a list, a dict, JSON or YAML.

Steps only plan; Spark runs them when a result is used. What depends on a recording (its mains frequency,
its bad channels, its components) is a table joined by recording, so all recordings go through at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import artifacts, bad_channels, channels, filtering, ica, quality, signals, spatial
from ..session import kept


@dataclass
class State:
    """What steps hand on: samples and their rate, the table of channels, annotations, and the steps done."""

    samples: DataFrame
    sfreq: float
    channels: DataFrame | None = None
    annotations: DataFrame | None = None
    history: list[str] = field(default_factory=list)

    def table(self) -> DataFrame:
        if self.channels is None:
            self.channels = kept(channels.described(self.samples))
        return self.channels

    def triggers(self) -> DataFrame:
        """Channels that hold codes, which no filter may touch."""
        return self.table().where("ch_type = 'stim'").select(*signals.KEY)


STEPS: dict[str, Callable] = {}


def register_step(name: str, step: Callable) -> None:
    """A step of one's own: ``step(state, **options)``."""
    STEPS[name] = step


def _step(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names:
            register_step(n, f)
        return f

    return add


@_step("filter", "bandpass")
def _filter(s: State, low: float | None = None, high: float | None = None, **options) -> None:
    """All channels but those of triggers."""
    s.samples = filtering.band_filter(s.samples, low, high, s.sfreq, triggers=s.triggers(), **options)


@_step("notch")
def _notch(s: State, frequency: float | str = "auto", **options) -> None:
    """All channels but those of triggers."""
    s.samples = artifacts.auto_notch(s.samples, s.sfreq, s.triggers()) if frequency == "auto" else filtering.notch_filter(s.samples, float(frequency), s.sfreq, triggers=s.triggers(), **options)


@_step("resample")
def _resample(s: State, sfreq: float) -> None:
    """Signals by a filter, trigger channels code by code."""
    s.samples, s.sfreq = filtering.resample(s.samples, s.sfreq, sfreq, triggers=s.triggers()), float(sfreq)


@_step("crop")
def _crop(s: State, tmin: float, tmax: float) -> None:
    from ..operators import annotations

    s.samples = signals.crop(s.samples, tmin, tmax, s.sfreq)
    if s.annotations is not None:
        s.annotations = annotations.crop(s.annotations, tmin, tmax)


@_step("pick")
def _pick(s: State, channels_: str | list | None = None, **options) -> None:
    s.channels = kept(channels.pick(s.table(), options.pop("channels", channels_), **options))
    s.samples = s.samples.join(s.channels.select(*signals.KEY), signals.KEY, "left_semi")


@_step("drop_channels")
def _drop(s: State, channels: list[str]) -> None:
    s.channels = signals.drop_channels(s.table(), channels)
    s.samples = signals.drop_channels(s.samples, channels)


@_step("rename_channels")
def _rename(s: State, names: dict[str, str]) -> None:
    s.channels, s.samples = signals.rename_channels(s.table(), names), signals.rename_channels(s.samples, names)


@_step("standardize_names")
def _standardise(s: State) -> None:
    """Names that clean to one are told apart by a number, in the order of the table."""
    from ..functions.names import clean_channel_name

    named = kept(channels.unique_names(s.table(), clean_channel_name(F.col("channel"))))
    s.samples = s.samples.join(named.select(*signals.KEY, "_new"), signals.KEY, "left").withColumn("channel", F.coalesce("_new", "channel")).drop("_new")
    s.channels = named.withColumn("channel", F.col("_new")).drop("_new")


@_step("set_channel_types")
def _types(s: State, types: dict[str, str]) -> None:
    s.channels = channels.set_types(s.table(), types)


@_step("set_montage")
def _montage(s: State, overwrite: bool = True) -> None:
    s.channels = channels.set_montage(s.table(), overwrite=overwrite)


@_step("set_bads")
def _bads(s: State, channels_: list[str] | None = None, add: bool = False, **options) -> None:
    s.channels = channels.set_bads(s.table(), options.pop("channels", channels_) or [], add)


@_step("detect_bad_channels")
def _detect(s: State, method: str = "quality") -> None:
    """Among EEG channels. PREP's prediction from others runs in recordings whose table has enough positions."""
    eeg = s.samples.join(s.table().where("ch_type = 'eeg'").select(*signals.KEY), signals.KEY, "left_semi")
    found = bad_channels.find_bad_channels(eeg, s.sfreq, s.table()).where("bad") if method == "prep" else quality.assess(eeg, s.sfreq).where("grade = 'bad'")
    s.channels = kept(channels.set_bads(s.table(), found, add=True))


@_step("interpolate_bads", "interpolate_bad_channels")
def _interpolate(s: State) -> None:
    s.samples = channels.apply_weights(s.samples, channels.interpolation(s.table()))
    s.channels = s.channels.withColumn("bad", F.col("bad") & (F.col("x").isNull() | (F.col("ch_type") != "eeg")))


@_step("reference", "rereference")
def _reference(s: State, reference: str | list[str] = "average", bad: list[str] | None = None, drop: bool = False) -> None:
    """EEG channels only; those marked bad aren't pooled."""
    s.samples = spatial.set_reference(s.samples, reference, bad, s.table(), drop)
    if drop and reference not in ("average", "median"):
        s.channels = signals.drop_channels(s.table(), [reference] if isinstance(reference, str) else reference)


@_step("bipolar")
def _bipolar(s: State, pairs: list | str = "double_banana") -> None:
    """Pairs of channels, or a montage by name (double_banana, transverse). A pair lies in the middle of its two, and is bad if one of them is; triggers stay."""
    table = s.table()
    pairs = spatial.BIPOLAR[pairs] if isinstance(pairs, str) else [tuple(p) for p in pairs]
    codes = s.samples.join(s.triggers(), signals.KEY, "left_semi")
    s.samples = spatial.bipolar(s.samples, pairs).unionByName(codes.select("recording", "channel", "sample", "value"))
    s.channels = kept(channels.bipolar_table(table, pairs))


@_step("laplacian")
def _laplacian(s: State, k: int = 4, method: str = "hjorth") -> None:
    """Of nearest neighbours (hjorth), or the current source density by splines (csd)."""
    placed = channels.set_montage(s.table(), overwrite=False)
    s.samples = channels.apply_weights(s.samples, channels.source_density(placed) if method == "csd" else channels.laplacian(placed, k))


@_step("ica")
def _ica(s: State, components: int | float | None = None, eye: list[str] | None = None, muscle: bool = False) -> None:
    """Takes out components that go with eye channels (EOG ones if none are named, frontal ones where there are none), and muscle ones if asked for.

    The model is of EEG channels that aren't bad, outside bad annotations; all other channels stay as they are."""
    from ..operators import annotations

    table = s.table()
    high = kept(filtering.band_filter(s.samples.join(table.where("ch_type <> 'stim'").select(*signals.KEY), signals.KEY, "left_semi"), 1.0, None, s.sfreq))
    spans = None if s.annotations is None else kept(annotations.bad_spans(s.annotations, s.sfreq))
    model = kept(ica.fit(ica.usable(high, table, spans), components))
    if eye is None:
        has_eog = table.where("ch_type = 'eog'").select("recording").distinct()
        frontal = table.where(F.col("channel").isin(artifacts.FRONTAL[:2])).join(has_eog, "recording", "left_anti")
        eyes = table.where("ch_type = 'eog'").select(*signals.KEY).unionByName(frontal.select(*signals.KEY))
    else:
        eyes = table.where(F.col("channel").isin(eye)).select(*signals.KEY)
    gone = ica.eye_components(high, model, s.sfreq, kept(eyes)).where("flagged").select("recording", "component")
    if muscle:
        gone = gone.unionByName(ica.muscle_components(high, model, s.sfreq).where("flagged").select("recording", "component"))
    numbered = gone.select("recording", F.substring("component", 3, 9).cast("int").alias("component"))
    s.samples = ica.remove(s.samples, model, kept(numbered))


@_step("annotate_artifacts")
def _annotate(s: State, blinks: bool = False) -> None:
    found = artifacts.annotate(s.samples, s.sfreq, blinks)
    s.annotations = found if s.annotations is None else s.annotations.unionByName(found)


@_step("envelope")
def _envelope(s: State, low: float, high: float) -> None:
    """Of all channels but those of triggers."""
    s.samples = filtering.envelope(s.samples, low, high, s.sfreq, s.triggers())


class Pipeline:
    """Steps (name, options), in order."""

    def __init__(self, steps: list[tuple[str, dict]]):
        unknown = [n for n, _ in steps if n not in STEPS]
        if unknown:
            raise ValueError(f"unknown steps: {unknown}")
        self.steps = steps

    @classmethod
    def from_config(cls, config: str | list | dict) -> Pipeline:
        """A list of names, of ``{name: options}``, of ``{step: name, ...}`` or of pairs; a dict with that list under ``steps``; or these as JSON or YAML text."""
        if isinstance(config, str):
            try:
                config = json.loads(config)
            except ValueError:
                import yaml

                config = yaml.safe_load(config)
        return cls([_normal(x) for x in (config["steps"] if isinstance(config, dict) else config)])

    def run(self, samples: DataFrame, sfreq: float, table: DataFrame | None = None, annotations: DataFrame | None = None) -> State:
        """All steps, planned one on the other."""
        state = State(samples, float(sfreq), table, annotations)
        for name, options in self.steps:
            STEPS[name](state, **options)
            state.history.append(f"{name}({', '.join(f'{k}={v!r}' for k, v in options.items())})")
        return state


def _normal(step) -> tuple[str, dict]:
    if isinstance(step, str):
        return step, {}
    if isinstance(step, dict):
        if "step" in step:
            return step["step"], {k: v for k, v in step.items() if k != "step"}
        ((name, options),) = step.items()
        return name, dict(options or {})
    name, options = step
    return name, dict(options)
