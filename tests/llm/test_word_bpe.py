import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from neurosheaf.llm import word_bpe
from neurosheaf.llm.queries import QUERIES

PATH = P.path("word_bpe_49k.json")
TEXTS = ["Hello world's  test\n\n x", "", None, "   ", "É" * 500, "a" * 30_000, "日本語のテキスト 🎉🎉", "\x00\x01 \u200b\x1c\x85x", "don't WE'LL I'M 12345 !!??\t\r\n end ", "a<|endoftext|>B <|startoftext|>", "aaab" * 5000, "ab " * 20_000, "ΑΣ Σ İ ǅ e\u0301\u0323 \u1c89x ꟋA \ua7da"]


@pytest.fixture(scope="module")
def official():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.Encoder(word_bpe.load(PATH))


def random_texts(n=2000):
    rng = random.Random(0)
    alphabet = ["a", "e", "t", "th", "ing", " ", " ", "\n", "é", "ß", "中", "🎉", "1", "9", "'s", "'", "!", "\t", "Zz", "\u0301", "<|endoftext|>", "<|", "Σ", "İ", "aa", "aaa", "...", "!!", "\x1c", "\x85"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(n)]


def test_encoding_equals_the_library(encoder, official):
    texts = [t or "" for t in TEXTS] + random_texts()
    for ids, t, want in zip(encoder.encode(texts), texts, official.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids, t[:60]
        assert encoder.decode(ids) == official.decode(ids, skip_special_tokens=False)


def test_every_character_of_some_blocks(encoder, official):
    texts = [f"a{chr(c)}b{chr(c)} {chr(c)}1" for a, b in ((0, 0x3000), (0xA640, 0xAB70), (0x1E900, 0x1F000)) for c in range(a, b)]
    assert encoder.encode(texts) == [e.ids for e in official.encode_batch(texts, add_special_tokens=False)]


def test_a_full_memo_changes_nothing(monkeypatch, official):
    monkeypatch.setattr(word_bpe, "MEMO", 50)
    e, texts = word_bpe.Encoder(word_bpe.load(PATH)), random_texts(300)
    for at in range(0, 300, 7):
        assert e.encode(texts[at : at + 7]) == [x.ids for x in official.encode_batch(texts[at : at + 7], add_special_tokens=False)]
    assert len(e.chunk_memo.newer) < 1000


def test_compatible_pairs_are_those_that_merging_keeps(encoder):
    rng = np.random.default_rng(1)
    ids = np.array([i for t, i in encoder.ids.items() if not t.endswith(word_bpe.END)])
    token = {i: t for t, i in encoder.ids.items()}
    short = ids[encoder.length[ids] <= 2]
    left, right = np.concatenate([rng.choice(ids, 4000), rng.choice(short, 4000)]), np.concatenate([rng.choice(list(token), 4000), rng.choice(short, 4000)])
    got = encoder.compatible(left, right)
    want = [encoder.merged(token[a] + token[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert got.tolist() == want and 0 < got.sum() < len(got)


def test_proposals_are_longest_matches_and_some_stand(encoder):
    words = ["hello" + word_bpe.END, "onthshatre" + word_bpe.END, "aaaaaaa" + word_bpe.END]
    ids, word, good = encoder.proposed(words)
    token = {i: t for t, i in encoder.ids.items()}
    for k, w in enumerate(words):
        at = 0
        for i in ids[word == k].tolist():
            assert token[i] == max((w[at:n] for n in range(at + 1, len(w) + 1) if w[at:n] in encoder.ids), key=len)
            at += len(token[i])
        if good[k]:
            assert ids[word == k].tolist() == encoder.merged(w)
    assert good[0]


def test_long_words_are_merged_by_a_heap(encoder):
    rng = random.Random(2)
    for _ in range(200):
        w = "".join(rng.choices("aabethin", k=rng.randint(1, 46))) + word_bpe.END
        assert encoder._merged_by_heap(encoder.symbols(w)) == encoder.merged(w)


def test_tables(spark, official):
    v = word_bpe.load(PATH)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(None, "a", "x", "y", 1)] * 2, "doc_id long, text string, n_tokens string, Decoded string, _text0 int")
    got = word_bpe.decode(word_bpe.encode(docs, v), v).collect()
    assert all(r.ids == official.encode(r.text or "", add_special_tokens=False).ids and r.decoded == official.decode(r.ids, skip_special_tokens=False) for r in got)
    assert len(got) == len(TEXTS) + 2 and all(r._text0 == 1 for r in got)
    table = {r.doc_id: r for r in word_bpe.digests(docs, v).collect()}
    assert table[1].n_tokens == table[2].n_tokens == 0 and table[1].ids_sha256 == table[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert word_bpe.digests(docs.limit(0), v).count() == word_bpe.encode(docs.limit(0), v).count() == 0


def test_query_against_the_library(spark, official):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_word_bpe"](spark, sf).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(docs)
    for r in rows:
        ids = official.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(official.decode(ids, skip_special_tokens=False)))
