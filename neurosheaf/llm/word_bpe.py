"""BPE of words with an end mark: longest matches propose, compatibility of neighbours verifies, merging mends the rest.

Texts are cut at white space into chunks; a chunk's tokens depend on nothing around it, so they are kept by chunk. The words
of all chunks that a batch meets for the first time are encoded together: one scan of an automaton proposes the longest token
at each place, all pairs of neighbouring tokens are looked at as arrays, and only words with a pair that plain merging would
not keep apart are merged one by one.

Two neighbours stay apart if at no time a merge takes what stands left and right of their border. Going back in
time, the later made of the two is taken apart, until both are single symbols; each such state lasts until one of the two is
merged into what it was taken from, and a merge across the border must not come before that.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import fresh, resident, slices, widened

#: Chunks and words (twice each) kept by a worker, and the length from which they aren't.
MEMO, LONGEST = 250_000, 256
#: Symbols from which a word's pairs are held in a heap.
MANY = 48
#: A rank after all others.
NEVER = 1 << 40
#: How a word's end and the border between words are written inside: beyond Latin-1, so that no byte is one.
END, APART = "\u0100", "\u0101"
#: What str.split() takes for white space beside Unicode's.
_CONTROLS = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\s+")


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What a tokenizer file says: tokens, merges in order, the end mark, the pattern of words and the special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.text, self.end = text, model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        cuts = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if (steps, cuts, spec["decoder"], model["type"]) != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, "BPE") or not self.end:
            raise ValueError("not a vocabulary of lower-cased words with an end mark")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


class Memo:
    """What was met of late: two tables of MEMO entries, the older of which goes when the newer is full."""

    def __init__(self):
        self.newer: dict = {}
        self.older: dict = {}

    def of(self, keys: set[str], make) -> dict:
        """A table that has all ``keys``; ``make`` gives those that aren't known."""
        if len(self.newer) >= MEMO:
            self.older, self.newer = self.newer, {}
        newer, older = self.newer, self.older
        lacking = keys.difference(newer)
        again = [k for k in lacking if k in older]  # not by an intersection, which goes through all of the older ones
        newer |= {k: older[k] for k in again}
        lacking.difference_update(again)
        long = {k for k in lacking if len(k) >= LONGEST}
        newer |= make(list(lacking - long))
        return newer | make(list(long)) if long else newer


class Encoder:
    def __init__(self, v: Vocabulary):
        self.library, self.byte = Tokenizer.from_str(v.text), byte_symbols()
        symbols = self.byte
        plain = lambda t: "".join(chr(symbols[c]) for c in t.removesuffix(v.end)) + END * t.endswith(v.end)
        size = max([*v.ids.values(), *v.specials.values()]) + 1
        self.names = [""] * size
        for t, i in chain(v.ids.items(), v.specials.items()):
            self.names[i] = t
        self.digits = [str(i) for i in range(size)]
        self.ids = {plain(t): i for t, i in v.ids.items()}
        self.find = regex.compile(v.pattern).findall
        self.specials = v.specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, v.specials)) + ")") if v.specials else None
        # Merges: of each token the two that it is made of and when; of each pair its rank.
        self.rank, made = {}, np.full(size, -1, np.int64)
        self.left, self.right = np.zeros((2, size), np.int64)
        twice = np.zeros(size, bool)
        for r, (a, b) in enumerate(v.merges):
            a, b, whole = v.ids[a], v.ids[b], v.ids[a + b]
            self.rank.setdefault((a, b), (r, whole))
            twice[whole] |= made[whole] >= 0
            made[whole], self.left[whole], self.right[whole] = r, a, b
        self.made = made
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.length = np.zeros(size, np.int64)
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.length[i] = len(t)
            self.trie.add_word(t, i)
        self.trie.make_automaton()
        # Tokens that merging makes of their own symbols, each by one way that takes made ones only.
        ordered = (made < 0) | (np.maximum(made[self.left], made[self.right]) < made)
        self.stable = np.zeros(size, bool)
        for t, i in self.ids.items():
            self.stable[i] = ordered[i] and not twice[i] and self.merged(t) == [i]
        self.chunk_memo, self.word_memo = Memo(), Memo()

    def symbols(self, word: str) -> list[int]:
        """The single symbols of a word; its last one is one with the end mark."""
        ends = word.endswith(END)
        parts = [*word[: len(word) - 2 * ends], word[-2:]] if ends else [*word]
        return [self.ids[p] for p in parts]

    def merged(self, word: str) -> list[int]:
        """Plain merging: the least rank first, the leftmost of equals."""
        ids, get, none = self.symbols(word), self.rank.get, (NEVER, -1)
        if len(ids) > MANY:
            return self._merged_by_heap(ids)
        costs = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while costs and (least := min(costs)) is not none:
            i = costs.index(least)
            ids[i : i + 2] = [least[1]]
            del costs[i]
            if i:
                costs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(costs):
                costs[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n steps."""
        n, get = len(ids), self.rank.get
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            if found := get((ids[i], ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                offer(i, j)
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in ids if i >= 0]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging keeps each pair of neighbours as they are."""
        ok = self.stable[left] & self.stable[right]
        at = np.flatnonzero(ok)
        a, b = left[at], right[at]
        until_a, until_b = np.full((2, len(at)), NEVER)
        while len(at):
            rank = self._ranks_of(a, b)
            # Of equal ranks the leftmost is first: left of the border before it, right of it after it.
            crosses = (rank < until_a) & (rank <= until_b) & (rank < NEVER)
            ok[at[crosses]] = False
            made_a, made_b = self.made[a], self.made[b]
            on = ~crosses & (np.maximum(made_a, made_b) >= 0)
            of_b = on & (made_b >= made_a)
            of_a = on & ~of_b
            until_b, b = np.where(of_b, made_b, until_b), np.where(of_b, self.left[b], b)
            until_a, a = np.where(of_a, made_a, until_a), np.where(of_a, self.right[a], a)
            at, a, b, until_a, until_b = at[on], a[on], b[on], until_a[on], until_b[on]
        return ok

    def proposed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest tokens of all words one after the other: ids, the word of each, and whether a word's are those that merging gives."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.trie.iter_long(APART.join(words))), np.int64).reshape(-1, 2)
        ids, ends = found[:, 1], found[:, 0] + 1
        word = np.searchsorted(starts, ends, "left") - 1
        begins = ends - self.length[ids]
        good = np.bincount(word, self.length[ids], len(words)) == sizes
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back] & (begins[inner + 1] == ends[inner])
        good[word[inner[~fits]]] = False
        good[word[~self.stable[ids]]] = False
        return ids, word, good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words, each ending in END."""
        if not words:
            return []
        ids, word, good = self.proposed(words)
        parts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = ids.tolist()
        return [ids[parts[k] : parts[k + 1]] if g else self.merged(words[k]) for k, g in enumerate(good.tolist())]

    def chunks(self, text: str) -> list[str]:
        return text.split() if not _CONTROLS.search(text) else [c for c in _WHITE.split(text) if c]

    def words(self, part: str) -> list[str]:
        """The words of a chunk without special tokens, as Latin-1 of their UTF-8 bytes."""
        if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
            return self.newer(part)
        lowered = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # a capital sigma gives the same small one everywhere
        return [w.encode().decode("latin-1") + END for w in self.find(lowered)]

    def newer(self, part: str) -> list[str]:
        """The same for characters that Python's tables don't have yet: by the library's."""
        names = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return ["".join(chr(self.byte[c]) for c in name) + END for name, _ in names]

    def learn(self, chunks: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of different chunks."""
        plan: list[tuple[str, list]] = []  # of each chunk its words and special ids
        for c in chunks:
            if self.special and "<" in c:
                plan.append((c, list(chain.from_iterable((self.specials[p],) if p in self.specials else self.words(p) for p in self.special.split(c) if p))))
            else:
                plan.append((c, self.words(c)))
        known = self.word_memo.of({w for _, parts in plan for w in parts if w.__class__ is str}, lambda words: dict(zip(words, map(tuple, self.encode_words(words)), strict=True)))
        return {c: known[p[0]] if len(p) == 1 and p[0] in known else tuple(chain.from_iterable((x,) if isinstance(x, int) else known[x] for x in p)) for c, p in plan}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of several texts."""
        cut = [self.chunks(t) for t in texts]
        known = self.chunk_memo.of(set().union(*cut), self.learn)
        return [list(chain.from_iterable(map(known.__getitem__, c))) for c in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' names between spaces, as the file has no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def _map_texts(docs: DataFrame, vocabulary: Vocabulary, text_col: str, columns: dict[str, tuple[str, pa.DataType]], result) -> DataFrame:
    """Adds columns, ``result(encoder, ids)`` of each text, in one pass and without a shuffle; those of ``docs`` by their names are replaced.

    The vocabulary (a few MB, bounded by its file) is broadcast, and each Python worker keeps one encoder."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary.text), hashlib.sha256(vocabulary.text.encode()).hexdigest()
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in columns}]
    name = fresh(docs.columns, "text")
    slim = docs.select(*kept, docs[text_col].alias(name))
    n = len(kept)

    def run(batches):
        e = resident(key, lambda: Encoder(Vocabulary(shared.value)))
        for b in slices(batches):
            found = [result(e, ids) for ids in e.encode([t.as_py() or "" for t in b.column(n)])]
            made = [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=[*b.schema.names[:n], *columns])

    return slim.mapInArrow(run, widened(docs.select(*kept), ", ".join(f"`{c}` {t}" for c, (t, _) in columns.items())))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``: array<int> of the ids of each whole text, as the tokenizers library gives them without adding special tokens.

    A null or empty text has none; special tokens written in a text are taken as such, as the library does. Rows are treated
    one by one, repeated ones alike, texts of any length in one piece. A column of the name is replaced, all others pass through.
    """
    return _map_texts(docs, vocabulary, text_col, {out_col: ("array<int>", pa.list_(pa.int32()))}, lambda e, ids: (np.array(ids, np.int32),))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the tokens of an array of ids between spaces, which is how the library decodes without a decoder; null: an empty string."""
    names = {i: t for t, i in chain(vocabulary.ids.items(), vocabulary.specials.items())}
    shared = tokens.sparkSession.sparkContext.broadcast(names)
    kept = [c for c in tokens.columns if c.lower() != out_col.lower()]
    n, name = len(kept), fresh(tokens.columns, "ids")

    def run(batches):
        get = shared.value.__getitem__
        for b in slices(batches):
            out = [" ".join(map(get, x.as_py() or ())) for x in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.string())], names=[*b.schema.names[:n], out_col])

    return tokens.select(*kept, tokens[ids_col].alias(name)).mapInArrow(run, widened(tokens.select(*kept), f"`{out_col}` string"))


def digests(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 (of decimal ids joined by one space) and decoded_sha256 (of the decoded text); see encode and decode for odd rows."""

    def digest(e: Encoder, ids: list[int]):
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return len(ids), sha(" ".join(map(e.digits.__getitem__, ids))), sha(e.decode(ids))

    return _map_texts(docs, vocabulary, text_col, {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}, digest)
