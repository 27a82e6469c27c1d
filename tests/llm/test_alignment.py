import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from neurosheaf.llm import alignment
from neurosheaf.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["Hello world's  test\n\n\n x", "", None, " ", "  ", "é" * 500, "a" * 3000, "日本語のテキスト 🎉🎉", "\x00\x01 ​\x1c \x1d", "don't we'll I'M 12345 !!??\t\r\n end ", "<|endoftext|> </s><s>", "a▁b", "ab " * 20_000, "\t \n x", "foo\t \nbar  baz", "Ᲊx Ꟛ", " lead", "trail  "]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def brute(texts):
    """The columns of each text, token by token."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    name = {i: bytes(byte[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    found, total = [], Counter()
    for t in texts:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        x, y = [name[i] for i in a], [piece(i) for i in b]
        if not t or not b"".join(x) == (" " + t).encode() == b"".join(y):
            found.append(None)
            continue
        i = j = at_x = at_y = 0
        groups, own, links = [], ([], []), []
        while i < len(a) or j < len(b):
            # Ranges overlap as long as both go on behind the other's begin.
            if i < len(a) and j < len(b) and at_x < at_y + len(y[j]) and at_y < at_x + len(x[i]):
                links.append((a[i], b[j]))
            end_x, end_y = at_x + len(x[i]), at_y + len(y[j])
            if end_x <= end_y:
                own[0].append(a[i])
                i, at_x = i + 1, end_x
            if end_y <= end_x:
                own[1].append(b[j])
                j, at_y = j + 1, end_y
            if at_x == at_y:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                own = ([], [])
        total.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, b), n in total.items():
        highest[b] = max(highest[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(total[k] == highest[k[1]] for k in f[3]), sum(total[k] for k in f[3]), f[4]) for f in found], total


def random_texts(n):
    rng = random.Random(3)
    alphabet = ["a", "e", "the", "ing", " ", " ", " ", "\n", "é", "ß", "中", "🎉", "1", "9", "'s", "!", "\t", "Zz", "́", "\r", " ", "\x1c", " ", "▁"]
    return ["".join(rng.choices(alphabet[: rng.choice([6, 23, 23, 24])], k=rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.load(A, B)


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_scores_equal_brute_force(spark, pair, head, monkeypatch):
    texts = TEXTS + random_texts(400) + TEXTS[:5]
    rows = [(i if i else None, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_A string, _row0 int, key int").repartition(3)
    got = {r.doc_id: r for r in alignment.score(docs, pair, head=head).collect()}
    want, _ = brute(texts)
    assert len(got) == len(texts) and all(r._row0 == 1 and r.key == 2 for r in got.values())
    for i, w in enumerate(want):
        assert tuple(got[i or None][c] for c in COLUMNS) == w, texts[i]


def test_pair_counts_and_long_texts_in_parts(spark, pair, monkeypatch):
    texts = random_texts(100) + ["word and word  again\n" * 50]
    monkeypatch.setattr(alignment, "PARTS", 7)
    want, total = brute(texts)
    e = alignment.Aligner(pair)
    for (n_a, n_b, groups, links, text, _, _), w in zip(alignment._aligned_rows(e, texts, False), want, strict=True):
        assert (n_a, n_b, groups, links, text) == (*w[:4], w[6])
    aligned = alignment.align(spark.createDataFrame([(t,) for t in texts], "text string"), pair)
    assert {(r.key // e.size_b, r.key % e.size_b): r.n for r in alignment.pair_counts(aligned).collect()} == total


def test_no_rows(spark, pair):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.score(docs, pair).count() == alignment.align(docs, pair).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text for r in docs])
    got = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, sf).collect()}
    for r, w in zip(docs, want, strict=True):
        row = got[r.doc_id]
        assert tuple(row[c] for c in COLUMNS[:6]) == w[:6] and row.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
