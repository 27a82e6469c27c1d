"""Alignment of two tokenizers' tokens over the same text.

Both tokenizers' tokens cover the same bytes, space and text. Cumulated lengths are the tokens' ends; ends that both have
cut the tokens into groups; tokens whose byte ranges overlap are linked. A batch of texts is one array for that.

A first pass writes each document's different links with their numbers; they are summed over the corpus by
a shuffle in two stages, the first of them salted. In a second pass each document's links are looked up: the most frequent pairs of ids, a
bounded number, in every task, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .common import Scratch, cut, fresh, gathered, most_frequent, resident, slices, widened
from .word_bpe import Memo, byte_symbols

#: Parts of texts aligned as one array, and links counted at a time.
PARTS, CHUNK = 40_000, 1 << 21
#: Pairs of ids whose counts every task has (17 bytes each); the others are joined.
HEAD = 1 << 18
SALTS = 16
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

#: Where a text may be cut: before a single space that a word follows. No token of either kind goes on after such a place.
_BORDER = regex.compile(r"(?<! )(?= \S)", regex.V1)
_RUN = regex.compile(r"\s\s")


class Pair:
    """The two tokenizers: the files' contents on the driver, the libraries' objects where they are used."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a_json, self.b_model = a_json, b_model
        self.key = hashlib.sha256(a_json.encode() + b_model).hexdigest()

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self):
        return self.a_json, self.b_model, self.key

    def __setstate__(self, state):
        self.a_json, self.b_model, self.key = state


class Aligner:
    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(pair.a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pair.b_model)
        byte = byte_symbols()
        names = json.loads(pair.a_json)["model"]["vocab"]
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in names.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        # Texts are cut if no piece has a space behind something else; else each is one part.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = max(self.a_bytes) + 1, len(pieces)
        self.length_a, self.length_b = np.zeros(self.size_a, np.int64), np.zeros(self.size_b, np.int64)
        for lengths, table in ((self.length_a, self.a_bytes), (self.length_b, self.b_bytes)):
            for i, t in table.items():
                lengths[i] = len(t)
        # Ids with what stands before them: a group's first and later ones of A, then of B.
        self.written = [f"{mark}{i}" for mark, n in ((";", self.size_a), (",", self.size_a), ("|", self.size_b), (",", self.size_b)) for i in range(n)]
        self.memo = Memo()

    def parts(self, text: str) -> list[str]:
        """Space and text, cut where both tokenizers cut; each part without its leading space."""
        if not self.cuts:
            return [text]
        if not _RUN.search(" " + text):
            return text.split(" ")
        return [p[1:] for p in _BORDER.split(" " + text) if p]

    def learn(self, parts: list[str]) -> dict[str, tuple[tuple, tuple] | None]:
        """The ids of both; none where the bytes of either aren't the part's."""
        out = {}
        spaced = [" " + p for p in parts]
        for p, s, x, b in zip(parts, spaced, self.a.encode_batch(spaced, add_special_tokens=False), self.b.encode(parts, num_threads=1), strict=True):
            # The library adds no space to nothing.
            a, b, own = x.ids, b if p else [self.b.piece_to_id("▁")], s.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == own == b"".join(map(self.b_bytes.__getitem__, b))
            out[p] = (tuple(a), tuple(b)) if same else None
        return out

    def aligned(self, rows: list[list[tuple[tuple, tuple]]]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each row of parts: its numbers of tokens, groups and links, its groups as text after a semicolon, and its different links (A id times B's number of ids, plus B id) with their numbers."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        owner = np.repeat(np.arange(len(rows)), sizes)
        ids, row = [], []
        for side in (0, 1):
            own = [p[side] for parts in rows for p in parts]
            ids.append(np.fromiter(chain.from_iterable(own), np.int64))
            row.append(np.repeat(owner, np.fromiter(map(len, own), np.int64, len(own))))
        (a, b), (row_a, row_b) = ids, row
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        begins_a, begins_b = ends_a - self.length_a[a], ends_b - self.length_b[b]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # Every A token is linked with the B tokens from the first that ends behind its begin to the last that begins before its end.
        first = np.searchsorted(ends_b, begins_a, "right")
        many = np.searchsorted(begins_b, ends_a, "left") - first
        of_a = np.repeat(np.arange(len(a)), many)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        span = self.size_a * self.size_b
        keys, times = np.unique(row_a[of_a] * span + a[of_a] * self.size_b + b[of_b], return_counts=True)
        at = np.searchsorted(keys, np.arange(len(rows) + 1) * span).tolist()
        # The ids in the order of groups, A before B.
        later_a, later_b = np.r_[False, group_a[1:] == group_a[:-1]][: len(a)], np.r_[False, group_b[1:] == group_b[:-1]][: len(b)]
        marks = np.concatenate([a + later_a * self.size_a, 2 * self.size_a + b + later_b * self.size_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        text = list(map(self.written.__getitem__, marks[order].tolist()))
        count = lambda rows_of: np.bincount(rows_of, minlength=len(rows)).tolist()
        n_a, n_b, n_groups, n_links = count(row_a), count(row_b), count(row_a[~later_a]), count(row_a[of_a])
        ends = np.cumsum(np.add(n_a, n_b)).tolist()
        return [
            (n_a[k], n_b[k], n_groups[k], n_links[k], "".join(text[ends[k] - n_a[k] - n_b[k] : ends[k]]), keys[at[k] : at[k + 1]] - k * span, times[at[k] : at[k + 1]])
            for k in range(len(rows))
        ]


class _Row:
    """What has been made of a text so far."""

    def __init__(self, digest: bool):
        self.n, self.keys, self.times, self.hash, self.text = [0, 0, 0, 0], [], [], hashlib.sha256() if digest else None, []

    def add(self, found) -> None:
        *counts, text, keys, times = found
        text = text if self.n[2] else text[1:]
        self.n = [x + y for x, y in zip(self.n, counts, strict=True)]
        if self.hash:
            self.hash.update(text.encode())
        else:
            self.text.append(text)
        self.keys.append(keys)
        self.times.append(times)

    def result(self, whole: bool):
        if not whole or not self.n[2]:
            return 0, 0, 0, 0, "", b"", b""
        keys, times = self.keys[0], self.times[0]
        if len(self.keys) > 1:
            keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            times = np.bincount(back, np.concatenate(self.times)).astype(np.int64)
        return *self.n, self.hash.hexdigest() if self.hash else "".join(self.text), np.diff(keys, prepend=0).astype("<i8").tobytes(), times.astype("<i4").tobytes()


def _aligned_rows(e: Aligner, texts: list[str], digest: bool) -> list[tuple]:
    """What a batch of texts gives. Long ones are aligned a few parts at a time, as a part's end is one of a group."""
    rows, whole = [_Row(digest) for _ in texts], [True] * len(texts)
    held, n = [], 0

    def flush():
        for (k, _), found in zip(held, e.aligned([x for _, x in held]), strict=True):
            rows[k].add(found)

    cut_texts = [e.parts(t) if t else [] for t in texts]
    known = e.memo.of(set().union(*cut_texts), e.learn)
    for k, parts in enumerate(cut_texts):
        own = list(map(known.__getitem__, parts))
        whole[k] = None not in own
        for at in range(0, len(own) if whole[k] else 0, PARTS):
            held.append((k, own[at : at + PARTS]))
            n += len(held[-1][1])
            if n >= PARTS:
                flush()
                held, n = [], 0
    if held:
        flush()
    return [r.result(w) for r, w in zip(rows, whole, strict=True)]


def align(docs: DataFrame, pair: Pair, text_col: str = "text", digest: bool = False) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, groups and the different links to ``docs``; no shuffle.

    groups is text, ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256 in hex. link_steps and link_times are arrays
    of little-endian longs and ints: the steps between the ascending keys (A id times B's number of ids, plus B id) and their
    numbers. Null and empty texts, and those that either tokenizer doesn't give back whole, have zeros, '' and no links.
    Columns of these names are replaced; rows are treated one by one.
    """
    sc, key = docs.sparkSession.sparkContext, pair.key
    shared = sc.broadcast(pair)
    made = [*COUNTS, "groups", "link_steps", "link_times"]
    kept = [c for c in docs.columns if c.lower() not in made]
    n, name = len(kept), fresh(docs.columns, "text")

    def run(batches):
        e = resident(key, lambda: Aligner(shared.value))
        for b in slices(batches):
            found = _aligned_rows(e, [t.as_py() for t in b.column(n)], digest)
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate([pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *columns], names=[*b.schema.names[:n], *made])

    schema = ", ".join(f"{c} long" for c in COUNTS) + ", groups string, link_steps binary, link_times binary"
    return docs.select(*kept, docs[text_col].alias(name)).mapInArrow(run, widened(docs.select(*kept), schema))


def _links(b: pa.RecordBatch, steps: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, keys and numbers of a batch's links."""
    own = [np.frombuffer(x.as_buffer(), "<i8") if x.is_valid else np.zeros(0, "<i8") for x in b.column(steps)]
    many = np.fromiter(map(len, own), np.int64, len(own))
    keys = np.concatenate([np.zeros(0, np.int64), *map(np.cumsum, own)])
    return np.repeat(np.arange(len(own)), many), keys, np.frombuffer(b"".join(x for x in b.column(times).to_pylist() if x), "<i4").astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): how many links of the whole corpus hold each pair. Summed in the tasks, then by pair and salt, then by pair."""

    def run(batches):
        held, size = [], 0

        def summed():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        def out(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for b in slices(batches):
            _, keys, n = _links(b, 0, 1)
            held.append((keys, n))
            size += len(keys)
            if size > CHUNK:
                held = [summed()]
                size = len(held[0][0])
                if size > CHUNK // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*summed())

    parts = aligned.select("link_steps", "link_times").mapInArrow(run, "key long, n long")
    salted = parts.groupBy("key", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """(key, n, best): whether no other pair of the same B id has a higher count."""
    b = F.pmod("key", F.lit(size_b)).alias("b")
    highest = counts.groupBy(b).agg(F.max("n").alias("highest"))
    return counts.select("key", "n", b).join(highest, "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best"))


def _scored(aligned: DataFrame, row: str, head: pa.Table, complete: bool) -> DataFrame:
    """(row, key, times, n_best, count_sum): sums over the links that are in ``head``, and a row for each link that isn't, if there are more pairs."""
    order = np.argsort(head["key"].to_numpy())
    table = [head[c].to_numpy(zero_copy_only=False)[order] for c in ("key", "n", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        keys, n, best = shared.value
        for b in slices(batches):
            row, own, times = _links(b, 1, 2)
            hit = np.zeros(len(own), bool)
            sums = np.zeros((2, b.num_rows), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                np.add.at(sums[0], row[hit], (times * best[at])[hit])
                np.add.at(sums[1], row[hit], (times * n[at])[hit])
            rest = np.flatnonzero(~hit) if not complete else np.zeros(0, np.int64)
            names, none = b.column(0).to_numpy(), np.zeros(len(rest), np.int64)
            columns = np.r_[names, names[row[rest]]], np.r_[np.full(len(names), -1), own[rest]], np.r_[np.zeros(len(names), np.int64), times[rest]], np.r_[sums[0], none], np.r_[sums[1], none]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["row", "key", "times", "n_best", "count_sum"])

    return aligned.select(row, "link_steps", "link_times").mapInArrow(run, "row long, key long, times long, n_best long, count_sum long")


def score(docs: DataFrame, pair: Pair, text_col: str = "text", digest: bool = False, head: int = HEAD) -> DataFrame:
    """``docs`` without ``text_col``, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups (see align).

    A pair's count is the number of links of all rows that hold it; n_best counts the row's links whose count is the highest
    of their B id, ties included, and count_sum sums the counts of its links. Repeated rows count as often as they are there. No rows:
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    row = fresh([*docs.columns, *COUNTS], "row")
    plain = [c for c in docs.columns if c.lower() not in {text_col.lower(), "n_best", "count_sum", *COUNTS, "groups", "link_steps", "link_times"}]
    aligned = scratch.keep(align(docs, pair, text_col, digest).select(*plain, *COUNTS, "groups", "link_steps", "link_times", F.monotonically_increasing_id().alias(row)))
    counts = scratch.keep(with_best(pair_counts(aligned), SentencePieceProcessor(model_proto=pair.b_model).get_piece_size()))
    often, rest = most_frequent(counts, "n", head)
    complete = rest is None
    parts = _scored(aligned, row, gathered(often), complete)
    if not complete:
        joined = parts.join(rest.select("key", F.col("n").alias("n"), F.col("best").cast("long").alias("best")), "key", "left")
        parts = joined.select("row", (F.col("n_best") + F.coalesce(F.col("times") * F.col("best"), F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"))
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = parts.select(F.col("row").alias(row), "n_best", "count_sum")
    found = aligned.select(*plain, *COUNTS, "groups", row).join(sums, row).select(*plain, *COUNTS, "n_best", "count_sum", "groups")
    out = cut(found)
    scratch.clear()
    return out
