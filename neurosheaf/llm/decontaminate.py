"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so a MinHash of a whole document says nothing about an
item in it. Items are therefore partitioned by size, and for each size class documents are cut into
windows of as many shingles as the largest item of the class has. An item that a document contains
lies in at most a few neighbouring windows, of which one shares a good part of its shingles; a window
and an item of the same class whose minima agree under any of the hash functions are a candidate, and
a candidate counts if the document's whole set of shingles holds enough of the item's. Items of a few shingles
are looked up by each of them instead, which misses none.

Windows of one class are unions of windows of the class below, so the minima of a class come from those
of the one below. Documents are never shuffled: a bounded block of items goes to every task, and a
larger benchmark is taken in several blocks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, resident

WIDTH, CONTAINMENT = 5, 0.8
#: Hash functions. By calculation, an item wholly inside a document misses all candidates with probability below 1e-7, and one
#: of which just 0.8 is there, each shingle in another window, with up to 3e-6.
FUNCTIONS = 48
#: Items of up to so many shingles are looked up by all their shingles.
DIRECT = 8
#: Shingles of the smallest class; each further class doubles it.
LEAST = 16
#: Shingles that a broadcast block of items may have (8 bytes each, and 48 minima an item); one larger item is a block by itself.
BLOCK_SHINGLES = 2_000_000
#: Shingles whose minima are taken at a time, and documents' shingles gathered before matching.
CHUNK, GATHERED = 1 << 16, 1 << 21
#: Words kept with their hashes by a worker.
MEMO = 200_000

_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.array([xxhash.xxh32_intdigest(b"%d" % i, 1) | 1 for i in range(FUNCTIONS)], np.uint32)
_STEPS = np.array([xxhash.xxh64_intdigest(b"step %d" % i, 1) | 1 for i in range(64)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return value


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words, in order; of a shorter text, of all its words; without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(resident("word hashes", _Hashes).__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _STEPS[i % 64]
        total ^= total >> np.uint64(29)
    return total * _STEPS[63]


def size_class(n: int) -> int:
    """The class of an item of n shingles: 0 up to LEAST, and one more each time that doubles."""
    return max(0, (n - 1).bit_length() - LEAST.bit_length() + 1)


class Items:
    """A block of items: their shingles, and the minima of each class with the items that have them."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.width = width
        self.ids = [i for i, _ in rows]
        self.sets = [np.unique(shingles(t, width)) for _, t in rows]
        by_class: dict[int, list[tuple[int, int, int]]] = {}
        for at, own in enumerate(self.sets):
            if len(own) > DIRECT:
                minima = ((own >> np.uint64(32)).astype(np.uint32)[None, :] * _MULTIPLIERS[:, None]).min(axis=1)
                by_class.setdefault(size_class(len(own)), []).extend((f, int(m), at) for f, m in enumerate(minima))
        self.classes = {}
        for k, found in by_class.items():
            tables = []
            for f in range(FUNCTIONS):
                own = sorted((m, at) for g, m, at in found if g == f)
                tables.append((np.array([m for m, _ in own], np.uint32), np.array([at for _, at in own], np.int64)))
            self.classes[k] = tables
        few = sorted((h, at) for at, own in enumerate(self.sets) if 0 < len(own) <= DIRECT for h in own.tolist())
        self.direct = np.array([h for h, _ in few], np.uint64), np.array([at for _, at in few], np.int64)
        self.filters: dict[tuple[int, int], np.ndarray] = {}

    def maybe(self, k: int, f: int) -> np.ndarray:
        """By the upper bits of a minimum, whether any item may have it."""
        if (k, f) not in self.filters:
            table = np.zeros(1 << 16, bool)
            table[self.classes[k][f][0] >> np.uint32(16)] = True
            self.filters[k, f] = table
        return self.filters[k, f]

    def looked_up(self, gathered: np.ndarray, owner: np.ndarray):
        """Pairs (document, item) of small items that share a shingle with the document; arguments as in candidates()."""
        hashes, items = self.direct
        if not len(hashes):
            return set()
        table = np.zeros(1 << 16, bool)
        table[hashes >> np.uint64(48)] = True
        hits = np.flatnonzero(table[gathered >> np.uint64(48)])
        lo, hi = np.searchsorted(hashes, gathered[hits], "left"), np.searchsorted(hashes, gathered[hits], "right")
        some = lo < hi
        return {(int(owner[h // LEAST]), int(i)) for h, a, b in zip(hits[some], lo[some], hi[some], strict=True) for i in items[a:b]}

    def candidates(self, gathered: np.ndarray, owner: np.ndarray):
        """Pairs (document, item) of equal minima, or of a small item's shingle. gathered: shingles, those of each document filled up to whole windows of LEAST; owner: the document of each such window."""
        found: set[tuple[int, int]] = self.looked_up(gathered, owner)
        if not self.classes:
            return found
        top = max(self.classes)
        high = (gathered >> np.uint64(32)).astype(np.uint32).reshape(-1, LEAST)
        step = max(1, CHUNK // LEAST)
        for at in range(0, len(high), step):
            part = np.ascontiguousarray(high[at : at + step].T)
            own = owner[at : at + step]
            firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for f in range(FUNCTIONS):
                minima, owners = (part * _MULTIPLIERS[f]).min(axis=0), own
                starts = firsts
                for k in range(top + 1):
                    if k:  # the windows of two of the class below, within a document
                        sizes = np.diff(np.r_[starts, len(minima)])
                        half = (sizes + 1) // 2
                        begin = np.r_[0, np.cumsum(half)[:-1]]
                        within = np.arange(half.sum()) - np.repeat(begin, half)
                        left = np.repeat(starts, half) + 2 * within
                        right = np.minimum(left + 1, np.repeat(starts + sizes - 1, half))
                        minima, owners, starts = np.minimum(minima[left], minima[right]), owners[left], begin
                    if k in self.classes:
                        hits = np.flatnonzero(self.maybe(k, f)[minima >> np.uint32(16)])
                        if len(hits):
                            values, items = self.classes[k][f]
                            lo, hi = np.searchsorted(values, minima[hits], "left"), np.searchsorted(values, minima[hits], "right")
                            for h, a, b in zip(hits[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                                doc = int(owners[h])
                                found.update((doc, int(i)) for i in items[a:b])
        return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of bounded size, one after the other."""
    sized = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    # Rows are numbered by ranges of a hash of the id, so each block is read by a filter.
    total = sized.agg(F.sum(F.length("t")), F.max(F.length("t"))).first()
    n = max(1, -(-(total[0] or 0) // (4 * BLOCK_SHINGLES)))
    for b in range(n):
        yield [(r.i, r.t) for r in sized.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).distinct().orderBy("i", "t").toLocalIterator()]


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = CONTAINMENT) -> DataFrame:
    """(doc id, item id, containment double) where a document holds at least ``least`` of an item's distinct shingles.

    Texts are whole, lower-cased, and split into runs of letters, digits and underscores; fewer words
    than ``width`` are one shingle. Items or documents without words, null texts and items without an
    id match nothing. A document row with a null id is reported with it. Repeated rows give repeated
    results; items that share an id are searched each, and the largest containment counts.
    """
    slim, out = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), None
    for rows in _blocks(benchmark, item_id, item_text):
        found = _search(slim, rows, width, least)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "containment")


def _search(slim: DataFrame, rows: list[tuple[int, str]], width: int, least: float) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(Items(rows, width))

    def run(batches):
        items: Items = shared.value

        def matched(ids, hashes):
            sizes = [-(-len(h) // LEAST) for h in hashes]
            # The rest of a last window repeats the last shingle, which changes no minimum.
            filled = [np.pad(h, (0, s * LEAST - len(h)), "edge") for h, s in zip(hashes, sizes, strict=True) if s]
            owner = np.repeat(np.arange(len(ids)), sizes)
            found = items.candidates(np.concatenate(filled), owner) if filled else ()
            best: dict[tuple[int, int], float] = {}
            sets: dict[int, set] = {}
            for doc, item in sorted(found):
                own = items.sets[item]
                if doc not in sets:
                    sets = {doc: np.unique(hashes[doc])}
                at = np.searchsorted(sets[doc], own)
                share = float((sets[doc][np.minimum(at, len(sets[doc]) - 1)] == own).mean())
                if share >= least:
                    best[doc, items.ids[item]] = max(share, best.get((doc, items.ids[item]), 0.0))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array(list(best.values()), pa.float64())], names=["doc", "item", "containment"]
            )

        for b in batches:
            ids, hashes, n = [], [], 0
            for i, t in zip(b.column(0), b.column(1), strict=True):
                h = shingles(t.as_py(), width)
                ids.append(i.as_py())
                hashes.append(h)
                n += len(h)
                if n >= GATHERED:
                    yield matched(ids, hashes)
                    ids, hashes, n = [], [], 0
            if ids:
                yield matched(ids, hashes)

    return slim.mapInArrow(run, "doc long, item long, containment double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that contain an item; rows without an id are judged by their text as well.

    The ids found come back by an anti-join, for which texts stay where they are unless very many are
    found; those of rows without an id come back by a hash of the text.
    """
    key, found_in = F.xxhash64(text_col), lambda rows: contained(rows, benchmark, "id", "text", **options).select("id").distinct()
    named, nameless = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    slim = lambda rows, own: rows.select(own.alias("id"), F.col(text_col).alias("text"))
    left = by_ids(named, found_in(slim(named, F.col(id_col))), {"id": F.col(id_col)}, "left_anti")
    return left.unionByName(by_ids(nameless, found_in(slim(nameless, key)), {"id": key}, "left_anti"))
