"""Byte-level BPE by longest matches with backtracking.

A word (one match of the pre-tokenizer) is mapped from bytes to Latin-1 characters, so that the trie of an
automaton over the vocabulary gives the longest token at a place. Tokens are taken longest
first. A token may follow another only if plain merging of the two together gives the two back; a
sequence whose neighbours are all compatible in that sense is the one that the merges give. When no
token fits, the last one is given up and the position is closed, so each position is opened once.
Compatibility is kept for every pair met, and the result for every word met.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import fresh, resident, slices, widened

#: Words (twice) and pairs of tokens kept by a worker, at most.
MEMO = 150_000
PAIRS = 2 * MEMO
#: Words of more characters aren't kept.
LONGEST = 256


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f)


class Encoder:
    """Encodes words by ranks; every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.reach = max(map(len, ranks))
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for t in ranks:
            self.trie.add_word(t.decode("latin-1"))
        self.within: dict[str, int | None] = {}  # bounded by the nodes of the trie
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int | None, int], bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank first, leftmost among equals: what compatibility is defined by."""
        get, none = self.ranks.get, 1 << 60
        parts = [word[i : i + 1] for i in range(len(word))]
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            costs[max(i - 1, 0) : i + 2] = [get(parts[j] + parts[j + 1], none) for j in (i - 1, i) if 0 <= j < len(parts) - 1]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int | None, right: int) -> bool:
        """Whether merging ``left`` and ``right`` together gives the two back. Without a left one: whether merging
        gives the token for its own bytes, as a vocabulary may hold some that it doesn't."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = [right] if left is None else [left, right]
            known = self.pairs[left, right] = self.merged(b"".join(map(self.token.__getitem__, both))) == both
        return known

    def longest(self, part: str) -> int | None:
        """The longest token that ``part`` begins with."""
        path = part[: self.trie.longest_prefix(part)]
        if path not in self.within:
            self.within[path] = next((r for n in range(len(path), 0, -1) if (r := self.ranks.get(path[:n].encode("latin-1"))) is not None), None)
        return self.within[path]

    def shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of another."""
        return self.longest(self.token[rank][:-1].decode("latin-1")) if self.length[rank] > 1 else None

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None and self.fits(None, whole):
            return [whole]
        text, n, length = word.decode("latin-1"), len(word), self.length
        at, ids, is_open = 0, [], bytearray(b"\1") * (n + 1)
        token = self.longest(text[: self.reach])
        while at < n:
            last = ids[-1] if ids else None
            while token is not None and not (is_open[at + length[token]] and self.fits(last, token)):
                token = self.shorter(token)
            if token is None:
                is_open[at] = 0
                last = ids.pop()
                at -= length[last]
                token = self.shorter(last)
            else:
                ids.append(token)
                at += length[token]
                token = self.longest(text[at : at + self.reach])
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words, extend = self.words, out.extend
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.older.get(w) or tuple(self.encode_word(w.encode()))
                if len(w) < LONGEST:
                    if len(words) >= MEMO:
                        self.older, self.words = words, {}
                        words = self.words
                    words[w] = ids
            extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _key(ranks: dict[bytes, int], pattern: str) -> str:
    h = hashlib.sha256(pattern.encode())
    for t, r in ranks.items():
        h.update(b"%d:%d:" % (r, len(t)) + t)
    return h.hexdigest()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``: array<int> of the ids of each whole text; null or empty text: an empty array.

    All other columns pass through. ``out_col`` may not be one of them. The vocabulary (a few MB, bounded by its file) is
    broadcast; there is no shuffle.
    """
    return _map_texts(docs, ranks, pattern, text_col, out_col, "array<int>", pa.list_(pa.int32()), lambda e, text: np.array(e.encode(text), np.int32))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Adds ``out_col``: the bytes that an array of ids stands for; null: empty."""
    shared = tokens.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def run(batches):
        token = shared.value
        for b in slices(batches):
            lists = (x.values for x in b.column(b.schema.get_field_index(ids_col)))
            out = [b"" if x is None else b"".join(map(token.__getitem__, x.to_pylist())) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, out_col])

    schema = widened(tokens, f"`{out_col}` binary")
    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out_col: str = "ids", whole_col: str = "round_trip") -> DataFrame:
    """encode(), and ``whole_col``: whether the bytes decoded from the ids are the text's. One pass over the texts, by one worker a task.

    A null or empty text has no ids and comes back whole; rows are treated one by one, repeated ones alike, and texts of any
    length in one piece. Columns of the two names in ``docs`` are replaced, all others pass through.
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {out_col.lower(), whole_col.lower()}))
    kind = pa.struct([(out_col, pa.list_(pa.int32())), (whole_col, pa.bool_())])

    def both(e: Encoder, text: str):
        ids = e.encode(text)
        return {out_col: np.array(ids, np.int32), whole_col: e.decode(ids) == text.encode()}

    name = fresh(docs.columns, "both")
    found = _map_texts(docs, ranks, pattern, text_col, name, f"struct<`{out_col}`:array<int>,`{whole_col}`:boolean>", kind, both)
    return found.select(*docs.columns, f"{name}.*")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the bytes decoded from the ids).

    A null or empty text has 0 tokens and the digests of nothing. Columns of the three names in ``docs`` are replaced.
    """

    def digest(e: Encoder, text: str):
        ids = e.encode(text)
        return {
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(e.decode(ids)).hexdigest(),
        }

    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    name = fresh(docs.columns, "digest")
    found = _map_texts(docs, ranks, pattern, text_col, name, "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>", kind, digest)
    return found.select(*(c for c in docs.columns if c.lower() not in {"n_tokens", "ids_sha256", "decoded_sha256"}), f"{name}.*")


def _map_texts(docs, ranks, pattern, text_col, out_col, spark_type, arrow_type, result) -> DataFrame:
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{out_col} is already a column")
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), _key(ranks, pattern)

    def run(batches):
        e = resident(key, lambda: Encoder(shared.value, pattern))
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text_col))
            out = [result(e, t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow_type)], names=[*b.schema.names, out_col])

    schema = widened(docs, f"`{out_col}` {spark_type}")
    return docs.mapInArrow(run, schema)
