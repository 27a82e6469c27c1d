"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Documents are indexed in segments, each with its own vocabulary, so that no term's postings ever meet in one place and a query's
work on a segment is a task of its own. A term's postings in a segment are cut into blocks of 128. A block holds steps between document
numbers and frequencies in variable bytes, and beside it stand its first and last document and the greatest impact in it.

A query's blocks cut a segment's documents into intervals within which no block begins or ends. The shallow moves of all its terms over all intervals
are made at once: each interval is bounded by the sum of its blocks' greatest impacts, with weights, without any of them being decompressed.
Intervals are then taken by descending bound, a few at a time; only their blocks are decompressed. When the k-th score found exceeds
all bounds that are left, the rest is skipped.

A document's score for an item sums w * ((1000000000 * tf) div (1000 * tf + 12 * m)) over the item's terms, repeats included, with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 75 + (25 * n * N) div L: N documents with a term, L terms, n of them in the document.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Scratch, cut, gathered, slices

#: Postings a block.
BLOCK = 128
#: Postings and documents from which a segment is closed.
POSTINGS, DOCUMENTS = 1 << 21, 1 << 16
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Terms of items that go to all tasks at once; of more items some are searched for after the others.
QUERY_TERMS = 1 << 19
#: Documents that a query's first intervals hold at least.
FIRST = 64

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
#: A-Z lower-cased, separators as spaces.
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """The terms of a whole text, UTF-8, and how often each is there."""
    folded, out, at = (text or b"").translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes, seven bits each, the last of a number with its upper bit set; and where each begins."""
    size = 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 9))
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > i)
        out[begin[own] + i] = values[own] >> 7 * i & 127 | np.where(size[own] == i + 1, 128, 0)
    return out, begin


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data & 128)
    begin = np.r_[0, last[:-1] + 1][: len(last)]
    out = np.zeros(len(last), np.int64)
    for i in range(int((last - begin).max(initial=-1)) + 1):
        own = np.flatnonzero(last - begin >= i)
        out[own] |= (data[begin[own] + i].astype(np.int64) & 127) << 7 * i
    return out


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., then those of begin[1]."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


class _Segment:
    """Documents until they are indexed."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)
        self.terms, self.tfs, self.lengths, self.names, self.size = [], [], [], [], 0

    def add(self, name: int | None, text: bytes | None) -> None:
        found = term_counts(text)
        if found:
            self.terms.append(np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found)))
            self.tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            self.lengths.append(int(self.tfs[-1].sum()))
            self.names.append(name)
            self.size += len(found)

    def rows(self, segment: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """A row a term (term, df, blocks, postings) and one, without a term, of the documents."""
        m = np.array([75 + 25 * n * n_docs // n_terms for n in self.lengths], np.int64)
        sizes = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        term, doc, tf = np.concatenate(self.terms), np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.tfs)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        df = np.bincount(term, minlength=len(self.ids))
        starts = np.cumsum(df) - df
        place = np.arange(len(term)) - starts[term]
        first = place % BLOCK == 0
        # A step counts from the document before it; a block's first document stands beside it.
        step = np.diff(doc, prepend=0) - 1
        step[first] = 0
        more = tf > 1
        values = np.zeros(len(step) + int(more.sum()), np.int64)
        at = np.arange(len(step)) + np.cumsum(more) - more
        values[at], values[at[more] + 1] = 2 * step + more, tf[more] - 2
        data, begin = packed(values)
        heads = np.flatnonzero(first)
        greatest = np.maximum.reduceat(impacts(tf, m[doc]), heads)
        last = doc[np.r_[heads[1:], len(doc)] - 1]
        ends = np.r_[begin[at[heads[1:]]], len(data)]
        # An end counts from the first byte of its term.
        owner, base = term[heads], begin[at[starts]]
        blocks = np.stack([doc[heads], last, greatest, ends - base[owner]], axis=1).astype("<i4")
        per_term = 16 * np.bincount(owner, minlength=len(df))
        named = np.array([x is not None for x in self.names], np.uint8).tobytes() + np.array([x or 0 for x in self.names], "<i8").tobytes()
        offsets = lambda n: pa.py_buffer(np.r_[0, np.cumsum(n)].astype("<i4").tobytes())
        whole = lambda extra, body, n: pa.Array.from_buffers(pa.binary(), len(n) + 1, [None, offsets(np.r_[n, len(extra)]), pa.py_buffer(body.tobytes() + extra)])
        terms = pa.array([*(t.decode() for t in self.ids), None], pa.string())
        spans = np.diff(np.r_[base, len(data)])
        columns = [pa.array(np.full(len(df) + 1, segment)), terms, pa.array(np.r_[df, len(m)]), whole(named, blocks, per_term), whole(m.astype("<i8").tobytes(), data, spans)]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "df", "blocks", "postings"])


class Index:
    """``entries`` (segment, term, df, blocks, postings) of all documents with a term, as a table in the shared folder, with N and L. clear() removes it."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = Scratch(docs.sparkSession, "lexical-index")
        slim = docs.select(F.col(id_col).cast("long"), F.col(text_col))
        self.n_docs, self.n_terms = self._totals(slim)
        n_docs, n_terms = self.n_docs, self.n_terms

        def run(batches):
            task, number, open_ = TaskContext.get().partitionId(), count(), _Segment()
            for b in slices(batches, 64):
                for name, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                    open_.add(name, text.as_py())
                    if open_.size >= POSTINGS or len(open_.names) >= DOCUMENTS:
                        yield open_.rows(task << 32 | next(number), n_docs, n_terms)
                        open_ = _Segment()
            if open_.size:
                yield open_.rows(task << 32 | next(number), n_docs, n_terms)

        self.entries = self.scratch.keep(slim.mapInArrow(run, "segment long, term string, df long, blocks binary, postings binary"), compression="zstd")

    @staticmethod
    def _totals(slim: DataFrame) -> tuple[int, int]:
        def run(batches):
            for b in slices(batches, 64):
                sizes = [term_counts(t.as_py()).total() for t in b.column(0).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)]), pa.array([sum(sizes)])], names=["docs", "terms"])

        found = slim.select(slim.columns[1]).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        return found[0] or 0, found[1] or 0

    def clear(self) -> None:
        self.scratch.clear()


class _Opened:
    """A segment's entries in a task: blocks side by side, decompressed when they are first asked for and kept then."""

    def __init__(self, entries: pa.Table):
        terms = entries["term"].to_pylist()
        names = terms.index(None)
        own = [i for i in range(len(terms)) if i != names]
        blocks, postings = entries["blocks"].to_pylist(), entries["postings"].to_pylist()
        self.m = np.frombuffer(postings[names], "<i8")
        n = len(self.m)
        self.named, self.names = np.frombuffer(blocks[names][:n], np.uint8), np.frombuffer(blocks[names][n:], "<i8")
        self.at = {terms[i]: k for k, i in enumerate(own)}
        table = np.frombuffer(b"".join(blocks[i] for i in own), "<i4").reshape(-1, 4).astype(np.int64)
        many = np.array([len(blocks[i]) // 16 for i in own], np.int64)
        self.first_block = np.r_[0, np.cumsum(many)]
        self.first, self.last, self.greatest = table[:, 0], table[:, 1], table[:, 2]
        self.data = np.frombuffer(b"".join(postings[i] for i in own), np.uint8)
        sizes = np.array([len(postings[i]) for i in own], np.int64)
        self.end = table[:, 3] + np.repeat(np.cumsum(sizes) - sizes, many)
        self.begin = np.r_[0, self.end[:-1]][: len(self.end)]
        df = entries["df"].to_numpy()[own] if own else np.zeros(0, np.int64)
        ends = self.first_block[1:] - 1
        self.sizes = np.full(len(self.last), BLOCK)
        self.sizes[ends] = df - (many - 1) * BLOCK
        self.place = np.cumsum(self.sizes) - self.sizes
        self.doc, self.impact = np.zeros((2, int(self.sizes.sum())), np.int64)
        self.ready = np.zeros(len(self.last), bool)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.ready[blocks]]
        if not len(blocks):
            return
        values = unpacked(self.data[ranges(self.begin[blocks], self.end[blocks] - self.begin[blocks])])
        sizes = self.sizes[blocks]
        at = _steps(values)
        steps, odd = values[at] >> 1, values[at] & 1 == 1
        tf = np.ones(len(at), np.int64)
        tf[odd] = values[at[odd] + 1] + 2
        heads = np.cumsum(sizes) - sizes
        total = np.cumsum(steps + 1)
        doc = total - np.repeat(total[heads], sizes) + np.repeat(self.first[blocks], sizes)
        to = ranges(self.place[blocks], sizes)
        self.doc[to], self.impact[to] = doc, impacts(tf, self.m[doc])
        self.ready[blocks] = True

    def search(self, terms: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers of the segment) and scores of the ``k`` best for weighted terms; of equal scores the least names."""
        own = [(self.at[t], w) for t, w in terms if t in self.at and w]
        which, weight = np.array([i for i, _ in own], np.int64), np.array([w for _, w in own], np.int64)
        many = self.first_block[which + 1] - self.first_block[which]
        blocks, weight = ranges(self.first_block[which], many), np.repeat(weight, many)
        doc = score = np.zeros(0, np.int64)
        if not len(blocks):
            return doc, score
        # Intervals end where a block ends or before one begins; a block bounds those from its first document to its last.
        ends = np.unique(np.r_[self.first[blocks] - 1, self.last[blocks]])
        low, high = np.searchsorted(ends, self.first[blocks]), np.searchsorted(ends, self.last[blocks])
        change = np.zeros(len(ends) + 1, np.int64)
        np.add.at(change, low, weight * self.greatest[blocks])
        np.subtract.at(change, high + 1, weight * self.greatest[blocks])
        bound, width = np.cumsum(change)[:-1], np.diff(ends, prepend=-1)
        order = np.argsort(-bound, kind="stable")
        reach = np.cumsum(width[order])
        at, room = 0, max(FIRST, 2 * k)
        while at < len(order):
            least = score[-1] if len(score) == k else 1
            stop = min(int(np.searchsorted(reach, (reach[at - 1] if at else 0) + room)) + 1, len(order))
            taken = order[at:stop]
            taken = taken[bound[taken] >= least]
            if not len(taken):
                break
            live = np.zeros(len(ends), bool)
            live[taken] = True
            before = np.r_[0, np.cumsum(live)]
            needed = before[high + 1] > before[low]
            self.decompress(blocks[needed])
            sizes = self.sizes[blocks[needed]]
            postings = ranges(self.place[blocks[needed]], sizes)
            docs = self.doc[postings]
            here = live[np.searchsorted(ends, docs)]
            sums = np.zeros(int(ends[-1]) + 1, np.int64)
            np.add.at(sums, docs[here], (np.repeat(weight[needed], sizes) * self.impact[postings])[here])
            hit = np.flatnonzero(sums)
            doc, score = np.r_[doc, hit], np.r_[score, sums[hit]]
            best = np.lexsort((self.names[doc], 1 - self.named[doc], -score))[:k]
            doc, score = doc[best], score[best]
            at, room = stop, 2 * room
        return doc, score


def _steps(values: np.ndarray) -> np.ndarray:
    """Where steps stand among values, of which one that follows an odd step is a frequency: what follows an even value
    is a step, be that one a step or a frequency, and from there on steps and frequencies take turns up to the next even value."""
    at = np.arange(len(values))
    even = np.maximum.accumulate(np.where(values & 1 == 1, -1, at))
    return np.flatnonzero((at - np.r_[-1, even[:-1]]) % 2 == 1)


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, doc_id, score): the ``k`` best documents with a score above 0 of each row of ``items``, equal scores by ascending doc_id.

    Ids that are null come last. Documents that are there twice are ranked twice; every row of items, repeated or without an id, has its own ranks.
    Null and empty texts have no terms and find nothing. No documents or no items: no rows.
    """
    spark = items.sparkSession
    texts = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in slices(batches):
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                found = term_counts(text.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()))], names=["item", "term", "times"])

    scratch = Scratch(spark, "lexical-search")
    texts = scratch.keep(texts)
    wanted = scratch.keep(texts.select("item", "text").mapInArrow(run, "item long, term string, times long"))
    terms = scratch.keep(wanted.select("term").distinct())
    few = terms.count() <= QUERY_TERMS
    entries = index.entries.where("term is not null").join(F.broadcast(terms) if few else terms, "term", "left_semi")
    counted = scratch.keep(entries.groupBy("term").agg(F.sum("df").alias("df")))
    weighted = scratch.keep(wanted.join(counted, "term").select("item", "term", "times", "df"))
    parts = max(1, math.ceil(weighted.count() / QUERY_TERMS))
    found = None
    for part in range(parts):
        own = weighted.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        # An item whose terms are too many for one part stays whole; its different terms are bounded by its text.
        here = _search_segments(index, entries, gathered(own), k)
        found = here if found is None else found.unionByName(here)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = ranked.join(texts.select("item", "id"), "item")
    out = cut(named.select(F.col("id").alias(id_col), "rank", "doc_id", "score"))
    scratch.clear()
    return out


def _search_segments(index: Index, entries: DataFrame, own: pa.Table, k: int) -> DataFrame:
    queries = defaultdict(list)
    for r in own.to_pylist():
        queries[r["item"]].append((r["term"], r["times"] * math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1)))))
    shared = entries.sparkSession.sparkContext.broadcast(dict(queries))

    def run(table: pa.Table) -> pa.Table:
        opened = _Opened(table)
        items, names, scores = [], [], []
        for item, terms in shared.value.items():
            doc, score = opened.search(terms, k)
            items += [item] * len(doc)
            names += [n if is_one else None for n, is_one in zip(opened.names[doc].tolist(), opened.named[doc].tolist(), strict=True)]
            scores += score.tolist()
        return pa.table([pa.array(items, pa.int64()), pa.array(names, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    schema = T.StructType.fromDDL("item long, doc_id long, score long")
    segments = entries.select("segment", "term", "df", "blocks", "postings").unionByName(index.entries.where("term is null"))
    return segments.groupBy("segment").applyInArrow(run, schema)
