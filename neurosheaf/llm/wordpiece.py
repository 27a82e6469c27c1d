"""Token counts of greedy longest-match word pieces, in time linear in the text (Song et al., 2021).

A trie holds the vocabulary. Where matching stops at a node, the pieces that a greedy matcher would
have cut off by then are known from the node alone: the automaton keeps how many, and from which node
matching goes on (the failure link). Counting then takes one step a byte, and no piece is built.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import resident, slices, widened

#: Words kept with their counts by a worker, twice.
MEMO = 150_000


class Automaton:
    """``first``: pieces a word may begin with; ``rest``: pieces that may follow (both bytes)."""

    def __init__(self, first: list[bytes], rest: list[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]  # node 0: start of a word, node 1: start of a further piece
        self.is_piece = [False, False]
        depth_one_up = [(0, p) for p in first] + [(1, p) for p in rest]
        for root, piece in depth_one_up:
            node = root
            for byte in piece:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.is_piece.append(False)
            if piece:
                self.is_piece[node] = True
        n = len(self.children)
        self.fail: list[int] = [-1] * n  # -1: no way to go on
        self.popped = [0] * n
        level = [(r, b, c) for r in (0, 1) for b, c in self.children[r].items()]
        while level:
            below = []
            for parent, byte, node in level:
                if self.is_piece[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and byte not in self.children[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.children[at][byte], popped
                below += [(node, b, c) for b, c in self.children[node].items()]
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; a word that can't be cut up is one unknown piece, and an empty one has none."""
        if not word:
            return 0
        children, fail, popped = self.children, self.fail, self.popped
        node, n = 0, 0
        for byte in word:
            while (to := children[node].get(byte, -1)) < 0:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node != 1:  # the end of the word matches nothing
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def from_byte_bpe(ranks: dict[bytes, int]) -> tuple[list[bytes], list[bytes]]:
    """First and further pieces of a byte-level vocabulary: tokens after a space, and those without one.

    The single bytes are pieces of both kinds, so that no word is unknown.
    """
    single = [bytes([i]) for i in range(256)]
    first = {t[1:] for t in ranks if t[:1] == b" " and t[1:2] not in (b"", b" ")}
    rest = {t for t in ranks if not t[:1].isspace()}
    return sorted(first | set(single)), sorted(rest | set(single))


def count_tokens(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Adds n_words and ``out_col`` (long): white-space separated words of each whole text, and their pieces.

    Null and empty texts have none. All other columns pass through; columns of the two names are
    replaced. There is no shuffle; what is broadcast is the vocabulary, whose size its file bounds.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {"n_words", out_col.lower()}))

    def run(batches):
        count = resident(key, lambda: Automaton(*shared.value)).count
        new: dict[bytes, int] = {}
        old: dict[bytes, int] = {}
        for b in slices(batches):
            words, tokens = [], []
            for text in b.column(b.schema.get_field_index(text_col)).cast(pa.large_binary()):
                split = (text.as_py() or b"").split()
                total = 0
                for w in split:
                    n = new.get(w)
                    if n is None:
                        n = old.get(w) or count(w)
                        if len(w) < 200:
                            if len(new) >= MEMO:
                                old, new = new, {}
                            new[w] = n
                    total += n
                words.append(len(split))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*b.schema.names, "n_words", out_col])

    schema = widened(docs, f"n_words long, `{out_col}` long")
    return docs.mapInArrow(run, schema)


def greedy_pieces(word: bytes, first: list[bytes] | set[bytes], rest: list[bytes] | set[bytes]) -> list[bytes] | None:
    """The pieces themselves, cut one after the other: the definition that counts are tested against."""
    first, rest, out, at = set(first), set(rest), [], 0
    while at < len(word):
        allowed = rest if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in allowed), None)
        if end is None:
            return None
        out.append(word[at:end])
        at = end
    return out
