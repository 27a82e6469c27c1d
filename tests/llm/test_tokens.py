import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from neurosheaf.llm import bpe, wordpiece

SCHEMA = "doc_id long, text string, n_words string, n_tokens string, extra int"
RANKS = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = ["Hello world's  test\n\n\n x", "", None, "   ", "é" * 500, "a" * 3000, "日本語のテキスト 🎉🎉", "\x00\x01 \u200b", "don't we'll I'M 12345 !!??\t\r\n end ", "<|endoftext|>", "aaab" * 5000, "ab " * 20_000]


@pytest.fixture(scope="module")
def official():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def random_texts(n=300):
    rng = random.Random(0)
    alphabet = ["a", "e", "t", "th", "ing", " ", " ", "\n", "é", "ß", "中", "🎉", "1", "9", "'s", "!", "\t", "Zz", "\u0301"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(n)]


def test_encoding_equals_the_library(official):
    e = bpe.Encoder(RANKS, P.PATTERN)
    for t in [x or "" for x in TEXTS] + random_texts():
        ids = e.encode(t)
        assert ids == official.encode_ordinary(t), t[:50]
        assert e.decode(ids) == t.encode()


def test_words_of_random_bytes(official):
    e, rng = bpe.Encoder(RANKS, P.PATTERN), random.Random(1)
    for _ in range(300):
        word = bytes(rng.choices(b"abcetinxyz\xc3\xa9\xe4\xb8\xad", k=rng.randint(1, 40)))
        assert e.encode_word(word) == official._core_bpe.encode_single_piece(word)


def test_encode_decode_and_digests(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(None, "a", "x", "y", 1)], SCHEMA)
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in got) and len(got) == len(TEXTS) + 1
    once = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert all(r.round_trip for r in once) and {r.doc_id: r.ids for r in once} == {r.doc_id: r.ids for r in got}
    table = {r.doc_id: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    assert table[1].n_tokens == table[2].n_tokens == 0 and table[1].ids_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, RANKS, P.PATTERN, out_col="EXTRA")


def test_counts_equal_greedy_pieces():
    rng = random.Random(2)
    for _ in range(40):
        pieces = ["".join(rng.choices("abc", k=rng.randint(1, 5))).encode() for _ in range(rng.randint(2, 30))]
        first, rest = pieces[::2], pieces[1::2]
        a = wordpiece.Automaton(first, rest)
        for _ in range(60):
            w = "".join(rng.choices("abcd", k=rng.randint(0, 14))).encode()
            want = wordpiece.greedy_pieces(w, first, rest)
            assert a.count(w) == (1 if want is None else len(want)), (w, first, rest)


def test_token_counts_of_documents(spark):
    vocabulary = wordpiece.from_byte_bpe(RANKS)
    first, rest = map(set, vocabulary)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_tokens(docs, vocabulary).collect()}
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        small = [w for w in words if len(w) <= 1500]
        if len(small) == len(words):
            cache = {w: len(wordpiece.greedy_pieces(w, first, rest)) for w in set(words)}
            assert got[i] == (len(words), sum(cache[w] for w in words)), i
    assert wordpiece.count_tokens(docs.limit(0), vocabulary).count() == 0


def test_rank_lines():
    assert bpe.parse_ranks([base64.b64encode(b"ab") + b" 7", b""]) == {b"ab": 7}
