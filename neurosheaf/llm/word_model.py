"""An interpolated modified Kneser-Ney model of word pairs over an unbounded vocabulary.

Words and pairs are 64-bit hashes. The log probability of a text is a sum of one term for each word and
each pair that the model has seen, and one constant a token:

    ln p(b | a) = base + [ln p(b) - base] + [ln gamma(a)] + [ln p(b | a) - ln gamma(a) - ln p(b)]

with the first bracket for known words, the second for known contexts and the third for known pairs. So a
document's distinct words and pairs are joined with the table of terms, sharded by hash, and summed. The most
frequent terms, a bounded number, are looked up where the texts are, and all others by the join. A bitmap of
bounded size tells of most words and pairs that no term is theirs; those have no part in the sum and aren't sent.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered, resident, slices

#: Hashes of what stands before and after a text.
BEFORE, AFTER = 1, 2
#: Terms that every task has (16 bytes each); the others are joined.
HEAD = 1 << 18
#: Bits of the bitmap of the other terms' keys (16 MB). With many more terms than bits it tells less, and more is sent.
FILTER_BITS = 1 << 27
#: Words whose two numbers are broadcast when the terms are made (two tables of some 80 bytes a word, which the driver holds
#: several times over while it makes them); more are joined by a shuffle.
BROADCAST_WORDS = 1 << 16
#: Parts of the texts, by their hash, that are scored one after the other: what they send stands on disk for one part at a time.
PASSES = 6
#: Words kept with their hashes by a worker; tokens of training text counted at a time.
MEMO, CHUNK = 200_000, 1 << 20

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 9)
        return value


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words and runs of marks, between the two boundaries."""
    words = _TOKEN.findall(text.lower())
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = BEFORE, AFTER
    out[1:-1] = np.fromiter(map(resident("model words", _Hashes).__getitem__, words), np.uint64, len(words))
    return out.view(np.int64)


def _hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (seed + _P5 + np.uint64(8)) ^ (turn(value * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(a, b) of neighbouring tokens."""
    t = tokens.view(np.uint64)
    return _hash_long(t[1:], _hash_long(t[:-1], np.full(len(t) - 1, 42, np.uint64))).view(np.int64)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, c): pairs of neighbouring tokens of all rows of the one text column; null and empty texts have none."""

    def run(batches):
        held, n = [], 0

        def counted():
            pairs = np.concatenate(held)
            _, at, counts = np.unique(np.concatenate([pair_keys(np.ascontiguousarray(p)) for p in tokens]), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs[at, 0]), pa.array(pairs[at, 1]), pa.array(counts)], names=["a", "b", "c"])

        tokens = []
        for b in slices(batches):
            for t in b.column(0):
                if t.as_py():
                    own = token_hashes(t.as_py())
                    tokens.append(own)
                    held.append(np.stack([own[:-1], own[1:]], axis=1))
                    n += len(own)
                    if n > CHUNK:
                        yield counted()
                        tokens, held, n = [], [], 0
        if held:
            yield counted()

    return texts.mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


class Model:
    """``terms`` (key, value, c), their most frequent ones and the bitmap of the others on the driver, and the constants of a token and of a text.

    ``scratch`` holds the terms; clear it when all scores are taken.
    """

    def __init__(self, texts: DataFrame, discounts):
        self.scratch = Scratch(texts.sparkSession, "word-model")
        pairs = self.scratch.keep(pair_counts(texts))
        lost = lambda d: F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        known = self.scratch.keep(pairs.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("c")))
        own, above = lost(discounts(known)), lost(discounts(pairs))
        total, left, words = known.agg(F.sum("c"), F.sum(F.least(own, F.col("c"))), F.count("*")).first()
        # The uniform share goes to all known words and one unknown.
        uniform = (left / total if total else 1.0) / (words + 1)
        self.base = float(np.log(uniform))
        p = known.select("w", ((F.col("c") - F.least(own, F.col("c"))) / F.lit(total or 1) + F.lit(uniform)).alias("p"))
        contexts = pairs.groupBy(F.col("a").alias("w")).agg(F.sum("c").alias("total"), F.sum(F.least(above, F.col("c"))).alias("lost"))
        vocabulary = self.scratch.keep(p.join(contexts, "w", "full_outer"))
        near = F.broadcast if vocabulary.count() <= BROADCAST_WORDS else lambda table: table.hint("shuffle_hash")
        first = near(vocabulary.where("lost is not null").select(F.col("w").alias("a"), "lost"))
        second = near(vocabulary.where("p is not null").select(F.col("w").alias("b"), "p"))
        # (c - d) / total + gamma p, over gamma p, where gamma is lost / total.
        ratio = 1 + (F.col("c") - F.least(above, F.col("c"))) / (F.col("lost") * F.col("p"))
        joined = pairs.join(first, "a").join(second, "b").select(F.xxhash64("a", "b").alias("key"), F.ln(ratio).alias("value"), "c")
        single = F.coalesce(F.ln("p") - self.base, F.lit(0.0)) + F.coalesce(F.ln(F.col("lost") / F.col("total")), F.lit(0.0))
        self.terms = self.scratch.keep(joined.union(vocabulary.select(F.col("w").alias("key"), single.alias("value"), F.coalesce("total", F.lit(1)).alias("c"))))
        self.scratch.drop(pairs, known, vocabulary)
        # Every text has one of each boundary.
        self.of_text = sum(r.value for r in self.terms.where(F.col("key").isin(BEFORE, AFTER)).collect())
        steps = self.terms.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("m")).collect()
        least, room = 100_001, HEAD
        for r in sorted(steps, key=lambda r: -r.c):
            room -= r.m
            if room < 0:
                break
            least = r.c
        self.complete = room >= 0
        head = gathered(self.terms.where(F.col("c") >= least).select("key", "value").orderBy("key"))
        self.keys, self.values = (head[c].to_numpy() for c in ("key", "value"))
        self.tail = self.terms.where(F.col("c") < least).select("key", "value")
        self.bitmap = np.zeros(1, np.int64) if self.complete else _bitmap(self.tail)
        pa.default_memory_pool().release_unused()


def _bitmap(tail: DataFrame) -> np.ndarray:
    """Longs whose bits are set at the keys' lower bits: FILTER_BITS / 64 rows at most reach the driver."""
    at = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast((key & {FILTER_BITS - 1}) & 63 as int))")
    found = gathered(tail.groupBy(F.shiftright(at, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for b in found.to_batches():
        out[b["at"].to_numpy()] = b["bits"].to_numpy()
    return out


def maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the bitmap's."""
    at = keys & (64 * len(bitmap) - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def text_key(text_col: str = "text"):
    return F.xxhash64(F.col(text_col))


def text_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(text_key, log_perplexity): mean -ln p a token of each different text that is not null or empty.

    The model's own folder holds the scores; all of it but them can go then."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.values, model.bitmap, model.base, model.of_text, model.complete))
    slim = docs.where(F.length(text_col) > 0).select(text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    passes = 1 if model.complete else PASSES
    parts = [model.scratch.keep(_scored(slim.where(F.pmod("text_key", F.lit(passes)) == k), model, shared)) for k in range(passes)]
    shared.destroy()
    return reduce(DataFrame.union, parts)


def _counted(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that aren't empty: their numbers of tokens and one, and for each text's different words and pairs its place, key and number."""
    tokens = [token_hashes(t.as_py()) for t in texts]
    ends = np.cumsum([len(x) for x in tokens])
    joined = np.concatenate(tokens)
    pairs = pair_keys(joined)
    found = [np.unique(np.concatenate([joined[at + 1 : end - 1], pairs[at : end - 1]]), return_counts=True) for at, end in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    place = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
    return np.diff(ends, prepend=0), place, np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _scored(slim: DataFrame, model: Model, shared) -> DataFrame:
    def run(batches):
        head, values, bitmap, base, of_text, complete = shared.value
        for b in slices(batches):
            if not b.num_rows:
                continue
            docs = b.column(0).to_numpy()
            sizes, place, keys, n = _counted(b.column(1))
            own = base * (sizes - 1) + of_text
            rest = np.full(len(keys), not complete)
            if len(head):
                at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
                hit = np.flatnonzero(head[at] == keys)
                own += np.bincount(place[hit], values[at[hit]] * n[hit], len(docs))
                rest[hit] = False
            if not complete:
                rest &= maybe(bitmap, keys)
            sent = np.flatnonzero(rest)
            # What is summed already is a row of its own, placed by its text; its n is the text's tokens, below 0.
            columns = np.r_[docs[place[sent]], docs], np.r_[keys[sent], docs], np.r_[n[sent], 1 - sizes], np.r_[np.zeros(len(sent)), own]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["text_key", "key", "n", "own"])

    parts = slim.mapInArrow(run, "text_key long, key long, n long, own double")
    if not model.complete:
        parts = parts.join(model.tail.hint("shuffle_hash"), "key", "left")
        parts = parts.withColumn("own", F.col("own") + F.when(F.col("n") > 0, F.col("n") * F.coalesce("value", F.lit(0.0))).otherwise(0.0))
    # Copies of a text have equal sums, so their mean is that of each.
    return parts.groupBy("text_key").agg((F.sum("own") / F.sum(F.least("n", F.lit(0)))).alias("log_perplexity"))
