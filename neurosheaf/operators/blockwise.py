"""Filters over channels of any length: in blocks, with the state that each block begins with from a parallel prefix.

A filter is linear, so a block's output is that from rest plus what its first state gives, and its last state is
``A^n first + push``. Such maps are composed in two levels: within runs of blocks, then over the runs of a channel, and back down. A
zero-phase filter goes over the blocks once more from the end; a block's backward push depends on its forward
state by one matrix, so one way up and down gives both. Signals are shuffled by block; between blocks go states alone, and
the first and last samples of each, of which the extensions at a channel's ends are made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..session import kept
from .signals import KEY, Whole, Wide, made_of, melt, remember

#: Samples a block, and blocks a run.
SIZE, RUN = 1 << 15, 1 << 10

_BLOCK = ["recording", "channel", "block"]


#: Channels that take more than a block, if known by a broadcast.
BROADCAST_CHANNELS = 100_000


def split(samples: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Samples of the channels that one block holds, and of the others; None if there are none. One pass over the numbers of samples tells."""
    own = made_of(samples)
    if isinstance(own, Whole) and own.short:
        return samples, None
    # The channels of a wide table have the same samples.
    rows, key = (own.rows, KEY[:1]) if isinstance(own, Wide) else (samples, KEY)
    ends = rows.groupBy(*key).agg(F.min("sample").alias("first"), F.max("sample").alias("last"))
    long = kept(ends.where(F.col("last") - F.col("first") >= SIZE).select(*key))
    n = long.count()
    if not n:
        return samples, None
    long = F.broadcast(long) if n <= BROADCAST_CHANNELS else long
    if isinstance(own, Wide):
        return tuple(melt(rows.join(long, key, how), own.channels) for how in ("left_anti", "left_semi"))
    return samples.join(long, key, "left_anti"), samples.join(long, key, "left_semi")


def _gathered(samples: DataFrame, size: int | None) -> DataFrame:
    """(recording, channel, block, s, values): numbers (s.sample) and values of a block's samples in order."""
    at = (F.lit(0).cast("long") if size is None else F.floor(F.col("sample") / F.lit(size))).alias("block")
    number, own = F.col("sample").cast("long").alias("sample"), made_of(samples)
    if not isinstance(own, Wide):
        rows = samples.select(*KEY, at, F.struct(number, F.col("value").cast("double").alias("value")).alias("s"))
        return rows.groupBy(*_BLOCK).agg(F.sort_array(F.collect_list("s")).alias("s")).select(*_BLOCK, "s", F.col("s.value").alias("values"))
    cells = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(own.channels)]
    rows = own.rows.select("recording", at, F.struct(number, *cells).alias("s"))
    blocks = rows.groupBy("recording", "block").agg(F.sort_array(F.collect_list("s")).alias("s"))
    each = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"s.v{i}").alias("values")) for i, c in enumerate(own.channels)))
    return blocks.select("recording", "block", "s", F.explode(each).alias("c")).select("recording", "c.channel", "block", "s", "c.values")


def in_blocks(samples: DataFrame, triggers: DataFrame | None = None, size: int | None = SIZE) -> DataFrame:
    """(recording, channel, block, coded, start, numbers, values): samples in order. numbers are theirs if some are missing between, else null.

    ``coded`` tells of channels in ``triggers``, which no filter may touch. Without a size each channel is one block."""
    own = made_of(samples)
    if isinstance(own, Whole) and size is None:
        blocks = own.blocks.select(*_BLOCK, "start", "numbers", "values")
    else:
        first, last = F.col("s")[0]["sample"], F.element_at("s", -1)["sample"]
        numbers = F.when(last - first + 1 != F.size("s"), F.col("s.sample")).alias("numbers")
        blocks = _gathered(samples, size).select(*_BLOCK, first.alias("start"), numbers, "values")
    if triggers is None:
        blocks = blocks.withColumn("coded", F.lit(False))
    else:
        codes = triggers.select(*KEY).distinct().withColumn("coded", F.lit(True))
        # Blocks stay where they are if few channels hold codes.
        codes = F.broadcast(codes) if codes.limit(BROADCAST_CHANNELS + 1).count() <= BROADCAST_CHANNELS else codes
        blocks = blocks.join(codes, KEY, "left").withColumn("coded", F.coalesce("coded", F.lit(False)))
    return blocks.select(*_BLOCK, "coded", "start", "numbers", "values")


def pieces(whole: DataFrame, size: int, block: str = "block") -> DataFrame:
    """(recording, block, channel, at, places, x): stretches of ``size`` samples of whole channels as arrays. ``places`` are the samples' in the
    block, or null if they follow each other from ``at``."""
    start, numbers, values, wide = F.col("start"), F.col("numbers"), F.col("values"), F.lit(size).cast("long")
    last = F.coalesce(F.element_at("numbers", -1), start + F.size(values) - 1)
    placed = whole.select(*KEY, "start", "numbers", "values", F.explode(F.sequence(F.floor(start / wide), F.floor(last / wide))).alias("_b"))
    k = F.col("_b")
    before = lambda end: F.size(F.filter(numbers, lambda s: s < end)).cast("long")
    at = F.greatest(start - k * wide, F.lit(0).cast("long"))
    first = F.when(numbers.isNull(), F.greatest(k * wide - start, F.lit(0).cast("long"))).otherwise(before(k * wide)).cast("int")
    count = F.when(numbers.isNull(), wide - at).otherwise(before((k + 1) * wide) - before(k * wide)).cast("int")
    places = F.transform(F.slice("numbers", first + 1, count), lambda s: s - k * wide)
    return placed.select("recording", k.alias(block), "channel", at.alias("at"), places.alias("places"), F.slice("values", first + 1, count).alias("x")).where(F.size("x") > 0)


def piece_matrix(at: list[int], places: pa.Array, x: pa.Array) -> np.ndarray:
    """pieces() of one block, a row each, at the samples up to the last; NaN where there is none."""
    values, numbers = _lists(x), [p.values.to_numpy() if p.is_valid else None for p in places]
    numbers = [np.arange(a, a + len(v)) if p is None else p for a, p, v in zip(at, numbers, values, strict=True)]
    out = np.full((len(values), max(int(p[-1]) for p in numbers) + 1), np.nan)
    for row, p, v in zip(out, numbers, values, strict=True):
        row[p] = v
    return out


def from_blocks(blocks: DataFrame) -> DataFrame:
    """(recording, channel, sample, value) of in_blocks()."""
    number = F.coalesce(F.get("numbers", F.col("i")), F.col("start") + F.col("i"))
    return blocks.select(*KEY, "start", "numbers", F.posexplode("values").alias("i", "value")).select(*KEY, number.alias("sample"), "value")


def _kind(blocks: DataFrame) -> str:
    return dict(blocks.dtypes)["recording"]


def padding(sos: np.ndarray) -> int:
    """Samples by which zero_phase() extends a signal at each end, if it has as many."""
    return 30 * (2 * len(sos) + 1)


@lru_cache(256)
def _powers(coefficients: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A^n, and the state that a filter run backwards over n samples ends with if forwards they began with a state: by doubling."""
    a, b, c, _ = filters._state_space(np.frombuffer(coefficients).reshape(-1, 6))
    if n == 0:
        return np.eye(len(b)), np.zeros_like(a)
    if n % 2:
        power, back = _powers(coefficients, n - 1)
        # One more sample, the last: A^(n-1) b c A^(n-1) is what it adds.
        return a @ power, back + power @ np.outer(b, c) @ power
    power, back = _powers(coefficients, n // 2)
    return power @ power, back + power @ back @ power


@lru_cache(4)
def _free(coefficients: bytes, n: int) -> np.ndarray:
    """The output of n samples of silence for each unit state."""
    sos = np.frombuffer(coefficients).reshape(-1, 6)
    return np.stack([filters.causal(sos, np.zeros(n), e)[0] for e in np.eye(2 * len(sos))], axis=1)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else None for x in column]


def _from_rest(blocks: DataFrame, sos: np.ndarray) -> DataFrame:
    """``blocks`` filtered from rest, with n, push, back (the push of the way back) and their first and last samples."""
    edge = padding(sos) + 1

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            coded, values = batch.column(names.index("coded")).to_pylist(), _lists(batch.column(names.index("values")))
            out = {"values": [], "n": [], "push": [], "back": [], "head": [], "tail": []}
            for held, x in zip(coded, values, strict=True):
                y, push = (x, np.zeros(2 * len(sos))) if held else filters.causal(sos, x)
                back = push if held else filters.causal(sos, y[::-1])[1]
                for k, v in zip(out, (y, len(x), push, back, x[:edge], x[-edge:]), strict=True):
                    out[k].append(v)
            kept_columns = [c for n, c in zip(names, batch.columns, strict=True) if n != "values"]
            made = [pa.array(v, pa.int64() if k == "n" else pa.list_(pa.float64())) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([*kept_columns, *made], names=[n for n in names if n != "values"] + list(out))

    schema = f"recording {_kind(blocks)}, channel string, block long, coded boolean, start long, numbers array<long>, values array<double>, n long, push array<double>, back array<double>, head array<double>, tail array<double>"
    return blocks.select(*_BLOCK, "coded", "start", "numbers", "values").mapInArrow(run, schema)


def _edges(heads: list[np.ndarray], edge: int) -> np.ndarray:
    """The first ``edge`` samples of blocks in order, of which each gives as many or all it has."""
    out = np.zeros(0)
    for h in heads:
        if len(out) >= edge:
            break
        out = np.r_[out, h]
    return out[:edge]


def _composed(rows: pd.DataFrame, key: bytes, edge: int, states: int) -> dict:
    """The map of a run of blocks in order: its sample count, forward push, and its backward push with what the forward state adds to it."""
    push, power = np.zeros(states), np.eye(states)
    steps = []
    for n, own in zip(rows.n, rows.push, strict=True):
        steps.append((power, push))
        own_power, _ = _powers(key, int(n))
        push, power = own_power @ push + np.asarray(own), own_power @ power
    back, feed = np.zeros(states), np.zeros((states, states))
    for (reached, offset), n, own in zip(reversed(steps), reversed(rows.n.tolist()), reversed(rows.back.tolist()), strict=True):
        own_power, turn = _powers(key, int(n))
        back, feed = own_power @ back + np.asarray(own) + turn @ offset, own_power @ feed + turn @ reached
    tails = [np.asarray(t)[::-1] for t in reversed(rows["tail"].tolist())]
    return {"n": int(rows.n.sum()), "push": push, "back": back, "feed": feed.ravel(), "head": _edges([np.asarray(h) for h in rows["head"]], edge), "tail": _edges(tails, edge)[::-1]}


def _ends(total: int, head: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """The state after the odd extension before a channel's first samples."""
    a, b, _, _ = filters._state_space(sos)
    pad = min(total - 1, padding(sos))
    wide = 2 * head[0] - head[pad:0:-1]
    return filters.causal(sos, wide, np.linalg.solve(np.eye(len(b)) - a, b) * wide[0])[1]


def _turn(total: int, tail: np.ndarray, state: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """The state with which the way back reaches a channel's last sample, from the forward state behind it."""
    a, b, _, _ = filters._state_space(sos)
    pad = min(total - 1, padding(sos))
    y = filters.causal(sos, 2 * tail[-1] - tail[-2 : -pad - 2 : -1], state)[0][::-1]
    return filters.causal(sos, y, np.linalg.solve(np.eye(len(b)) - a, b) * y[0])[1]


def _entering(passed: DataFrame, sos: np.ndarray, zero_phase: bool) -> DataFrame:
    """(recording, channel, block, first, last): the states with which a block begins forwards and backwards; null for a channel of one sample."""
    key, edge, states, kind = np.ascontiguousarray(sos, float).tobytes(), padding(sos) + 1, 2 * len(sos), _kind(passed)
    lists = "push array<double>, back array<double>"
    summary = passed.where("not coded").select(*_BLOCK, F.floor(F.col("block") / RUN).alias("run"), "n", "push", "back", "head", "tail")

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame([{"recording": rows.recording.iloc[0], "channel": rows.channel.iloc[0], "run": rows.run.iloc[0], **_composed(rows, key, edge, states)}])

    runs = summary.groupBy(*KEY, "run").applyInPandas(up, f"recording {kind}, channel string, run long, n long, {lists}, feed array<double>, head array<double>, tail array<double>")

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        total, heads = int(rows.n.sum()), [np.asarray(h) for h in rows["head"]]
        first, last = [], []
        if total > 1:
            state = _ends(total, _edges(heads, edge), sos) if zero_phase else np.zeros(states)
            for n, push in zip(rows.n, rows.push, strict=True):
                first.append(state)
                state = _powers(key, int(n))[0] @ state + np.asarray(push)
            if zero_phase:
                state = _turn(total, _edges([np.asarray(t)[::-1] for t in reversed(rows["tail"].tolist())], edge)[::-1], state, sos)
            for n, back, feed, own in zip(*(reversed(x) for x in (rows.n.tolist(), rows.back.tolist(), rows.feed.tolist(), first)), strict=True):
                last.append(state)
                state = _powers(key, int(n))[0] @ state + np.asarray(back) + np.asarray(feed).reshape(states, states) @ own
        none = [None] * len(rows)
        return pd.DataFrame({"recording": rows.recording.iloc[0], "channel": rows.channel.iloc[0], "run": rows.run.to_numpy(), "first": first or none, "last": last[::-1] or none})

    begun = runs.groupBy(*KEY).applyInPandas(across, f"recording {kind}, channel string, run long, first array<double>, last array<double>")

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        first, last = [None] * len(rows), [None] * len(rows)
        if rows["first"].iloc[0] is not None:
            state = np.asarray(rows["first"].iloc[0])
            for i, (n, push) in enumerate(zip(rows.n, rows.push, strict=True)):
                first[i] = state
                state = _powers(key, int(n))[0] @ state + np.asarray(push)
            state = np.asarray(rows["last"].iloc[0])
            for i, n, back in zip(reversed(range(len(rows))), reversed(rows.n.tolist()), reversed(rows.back.tolist()), strict=True):
                last[i] = state
                power, turn = _powers(key, int(n))
                state = power @ state + np.asarray(back) + turn @ first[i]
        return pd.DataFrame({"recording": rows.recording.iloc[0], "channel": rows.channel.iloc[0], "block": rows.block.to_numpy(), "first": first, "last": last})

    both = summary.select(*_BLOCK, "run", "n", "push", "back").join(begun, [*KEY, "run"])
    return both.groupBy(*KEY, "run").applyInPandas(down, f"recording {kind}, channel string, block long, first array<double>, last array<double>")


def changed(blocks: DataFrame, change: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """``blocks`` with what ``change(values, *more)`` makes of each row's values; ``more`` are columns. Batches of rows are gone
    through, as a group of pandas a channel would cost more than most filters of a short one."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            told = [batch.column(names.index(c)).to_pylist() for c in more]
            out = [change(x, *own) for x, *own in zip(_lists(batch.column(names.index("values"))), *told, strict=True)]
            columns = [batch.column(names.index(c)) for c in (*_BLOCK, "coded", "start", "numbers")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=[*_BLOCK, "coded", "start", "numbers", "values"])

    return blocks.select(*_BLOCK, "coded", "start", "numbers", "values", *(c for c in more if c != "coded")).mapInArrow(run, f"recording {_kind(blocks)}, channel string, block long, coded boolean, start long, numbers array<long>, values array<double>")


def filtered(samples: DataFrame, stages: list[np.ndarray], zero_phase: bool = True, triggers: DataFrame | None = None) -> DataFrame:
    """Samples filtered by one cascade after another: channels of a block where they are, longer ones by iir()."""
    short, long = split(samples)

    def change(x: np.ndarray, held: bool) -> np.ndarray:
        for sos in () if held else stages:
            x = filters.zero_phase(sos, x) if zero_phase else filters.causal(sos, x)[0]
        return x

    whole = changed(in_blocks(short, triggers, None), change, "coded")
    made = from_blocks(whole)
    if long is None:
        return remember(made, Whole(whole, True))
    blocks = in_blocks(long, triggers)
    for sos in stages:
        blocks = iir(blocks, sos, zero_phase)
    return made.unionByName(from_blocks(blocks))


def iir(blocks: DataFrame, sos: np.ndarray, zero_phase: bool = True) -> DataFrame:
    """in_blocks() filtered by second-order sections, forwards and backwards as filters.zero_phase() or forwards from rest; coded channels as they are.

    What the blocks give from rest is written to the shared folder, as both the states and the result are made of it."""
    key = np.ascontiguousarray(sos, float).tobytes()
    passed = kept(_from_rest(blocks, sos))
    joined = passed.drop("n", "push", "back", "tail").join(_entering(passed, sos, zero_phase), _BLOCK, "left")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            first, last, values, head = (_lists(batch.column(names.index(c))) for c in ("first", "last", "values", "head"))
            coded, out = batch.column(names.index("coded")).to_pylist(), []
            for held, y, s, t, x in zip(coded, values, first, last, head, strict=True):
                if held or (s is None and zero_phase):  # one sample is its own
                    y = y if held else x
                elif s is not None:
                    y = y + _free(key, max(SIZE, len(y)))[: len(y)] @ s
                    y = filters.causal(sos, y[::-1], t)[0][::-1] if zero_phase else y
                out.append(y)
            columns = [batch.column(names.index(c)) for c in (*_BLOCK, "coded", "start", "numbers")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=[*_BLOCK, "coded", "start", "numbers", "values"])

    return joined.mapInArrow(run, f"recording {_kind(blocks)}, channel string, block long, coded boolean, start long, numbers array<long>, values array<double>")


def fir(samples: DataFrame, taps: np.ndarray, zero_phase: bool = True, triggers: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """Samples convolved with taps: centred over reflected ends as filters.fir_zero_phase(), or forwards from silence.

    A block takes with it the samples around it that the taps reach, so nothing else is shuffled. Samples are numbered without gaps."""
    half = len(taps) // 2 if zero_phase else len(taps) - 1
    behind = half if zero_phase else 0
    used = samples.select(*KEY, F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"))
    coded = None
    if triggers is not None:
        codes = triggers.select(*KEY).distinct()
        used, coded = used.join(codes, KEY, "left_anti"), used.join(codes, KEY, "left_semi")
    size = max(size, len(taps))
    block = lambda by: F.floor((F.col("sample") + by) / F.lit(size))
    rows = used.select(*KEY, F.explode(F.sequence(block(-behind), block(half))).alias("block"), F.struct("sample", "value").alias("s"))
    groups = rows.groupBy(*_BLOCK).agg(F.sort_array(F.collect_list("s")).alias("s")).select(*_BLOCK, F.col("s")[0]["sample"].alias("start"), F.col("s.value").alias("values"))

    def run(batches):
        for batch in batches:
            starts, out = [], []
            for k, start, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _lists(batch.column(4)), strict=True):
                # A side that lacks samples is an end of the channel.
                own = slice(max(k * size - start, 0), max((k + 1) * size - start, 0))
                count = len(x[own])
                left = half - own.start
                right = half - (len(x) - own.start - count) if zero_phase else 0
                if not count:
                    y = np.zeros(0)
                elif zero_phase:
                    ends = (max(left, 0), max(right, 0))
                    wide = np.pad(x, ends, "reflect" if len(x) > 1 else "edge")
                    y = filters.convolved(wide, taps)[2 * half :][max(-left, 0) : max(-left, 0) + count]
                else:
                    y = filters.convolved(np.r_[np.zeros(max(left, 0)), x], taps)[half + max(-left, 0) :][:count]
                starts.append(start + own.start)
                out.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(starts, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=[*KEY, "start", "values"])

    found = groups.mapInArrow(run, f"recording {_kind(groups)}, channel string, start long, values array<double>")
    found = found.select(*KEY, "start", F.posexplode("values").alias("i", "value")).select(*KEY, (F.col("start") + F.col("i")).alias("sample"), "value")
    return found if coded is None else found.unionByName(coded)
