"""The registered queries: each operator over its whole table, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, hilbert, kneser_ney, licenses, quality_rules, ranked_search, simhash, url_filter, warc, word_bpe, wordpiece
from ..session import ship
from .common import read

SHARDS = 16
URL_RULES = [
    url_filter.UrlRule("com", "/", "allow"),
    url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"),
    url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
]


@cache
def _ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> dict[bytes, int]:
    return bpe.load_ranks(public_tokenizers.path(name))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hilbert order of language, source and size, cut into 16 runs; law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    axes = [hilbert.by_hash(F.col("lang"), 4), hilbert.by_hash(F.col("source"), 4), hilbert.by_log2(F.col("size"), 4)]
    placed = hilbert.hilbert_shards(docs, axes, 4, SHARDS, F.col("doc_id"), (F.col("size"), F.col("text_crc32")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.summarise(licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge_ids(docs, read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, wordpiece.from_byte_bpe(_ranks())).select("doc_id", "n_words", "n_tokens")


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("problem")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, _ranks(), public_tokenizers.PATTERN).drop("text")


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.judge(pages.select("page_id", "url"), URL_RULES, url_filter.page_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    judged = kneser_ney.classify_ids(docs.select("doc_id", "lang", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "log_perplexity", "threshold", "kept")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def word_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return word_bpe.digests(docs, word_bpe.load(public_tokenizers.path("word_bpe_49k.json"))).drop("text")


def cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pair = alignment.Pair.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.score(read(spark, sf_dir, "documents").select("doc_id", "text"), pair, digest=True).withColumnRenamed("groups", "groups_sha256")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    index = ranked_search.Index(read(spark, sf_dir, "documents"))
    found = ranked_search.search(index, read(spark, sf_dir, "benchmark"))
    index.clear()
    return found


QUERIES = {
    "op1_hilbert_shards": sharding,
    "op2_simhash": near_duplicates,
    "op3_license_scan": license_scan,
    "op4_quality_rules": quality,
    "op5_token_counts": token_counts,
    "op6_warc": warc_round_trip,
    "op7_byte_bpe": byte_bpe,
    "op8_url_filter": url_verdicts,
    "op9_kneser_ney": perplexity,
    "op10_decontamination": decontamination,
    "op11_word_bpe": word_bpe_digests,
    "op12_token_alignment": cross_tokenizer,
    "op13_ranked_search": ranked,
}

_WHITE = r"[\x20\x09-\x0D]"


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        out.append(n)
    return out


def _sharding_sql() -> str:
    nibble = lambda c: f"(CAST('0x' || substr(md5({c}), 1, 7) AS BIGINT) % 16)"
    cell = f"{nibble('lang')} * 256 + {nibble('source')} * 16 + least(length(bin(size)), 15)"
    return f"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents), s AS (SELECT *, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size FROM t),
tables AS (SELECT {_crc_table()} AS crc, {hilbert.hilbert_order(3, 4)} AS hilbert),
c AS (SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  hilbert[{cell} + 1] AS curve, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT) % 1024 AS slice FROM s, tables),
r AS (SELECT *, row_number() OVER (ORDER BY curve, slice, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM c), h AS (SELECT *, ({SHARDS} * place) // total AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS INTEGER) AS curve FROM h"""


def _quality_sql() -> str:
    rungs = ", ".join(f"('{f}', {i}, CAST({c} AS DOUBLE))" for f, ladder in quality_rules.LADDERS.items() for i, c in enumerate(ladder))
    values = {"symbols_per_char": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_word_share": "n_repeat_words / greatest(n_words, 1)", "chars_per_word": "word_chars / greatest(n_words, 1)"}
    union = " UNION ALL ".join(f"SELECT row, doc_id, lang, failed, '{f}' AS feature, CAST({v} AS DOUBLE) AS value FROM m" for f, v in values.items())
    a = quality_rules.ALPHA
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln(1 - {a}))"
    return f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, list_filter(regexp_split_to_array(text, '{_WHITE}+'), lambda x: x <> '') AS words FROM t),
g AS (SELECT row, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3), win AS (SELECT row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
twice AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, a, b, c) > 1), covered AS (SELECT DISTINCT row, i + unnest([0, 1, 2]) AS i FROM twice), rep AS (SELECT row, count(*) AS n_repeat_words FROM covered GROUP BY ALL),
l AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m0 AS (SELECT row, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '{_WHITE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM t JOIN w USING (row) JOIN l USING (row) LEFT JOIN rep USING (row)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM m0), v AS ({union}), ladder(feature, step, cutoff) AS (VALUES {rungs}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1), once AS (SELECT doc_id, lang, min(row) AS row FROM m WHERE NOT failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL), copies AS (SELECT min(once.row) AS row FROM once JOIN t ON t.row = once.row GROUP BY once.lang, t.text),
held AS (SELECT * FROM v WHERE row IN (SELECT row FROM copies)),
k AS (SELECT lang, feature, step, cutoff, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN value > cutoff THEN 1 ELSE 0 END) AS BIGINT) AS k FROM held JOIN ladder USING (feature) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {a} THEN 1.0 ELSE (SELECT sum({term}) FROM (SELECT unnest(range(k + 1)) AS j)) END AS p FROM k),
ok AS (SELECT lang, feature, cutoff FROM p QUALIFY max(CASE WHEN p > {quality_rules.DELTA} / ((SELECT count(DISTINCT lang) FROM held) * {len(values)}) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, feature ORDER BY step) = 0),
bar AS (SELECT lang, feature, min(cutoff) AS cutoff FROM ok GROUP BY ALL), bad AS (SELECT DISTINCT row FROM v JOIN bar USING (lang, feature) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND row NOT IN (SELECT row FROM bad) AS kept FROM m"""


_WARC_SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND first <> page_id THEN first END AS refers_to FROM f"""


def _url_sql() -> str:
    after = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)
    split = lambda frm, u, cols: f"SELECT {cols}, coalesce(translate(regexp_extract({after(u)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract({after(u)}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM {frm}"
    best = lambda frm, key: f"SELECT {key}, rule, verdict FROM (SELECT x.{key}, r.h || r.p AS rule, r.v AS verdict, row_number() OVER (PARTITION BY x.{key} ORDER BY length(r.h || r.p) DESC, r.v) AS n FROM {frm} x JOIN rules r ON (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p)) WHERE n = 1"
    node = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(split_part({u}, '#', 1), '^([^/?]*://)', 1) || translate(regexp_extract(substr(split_part({u}, '#', 1), strpos({u}, '://') + 3), '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(split_part({u}, '#', 1), strpos({u}, '://') + 3), '^[^/?]*(.*)$', 1, 's') END"
    link = r"(?is)<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*\bhref\s*=\s*[\"'']?([^\s>\"'']+)"
    turned = r"(?is)<link\b[^>]*\bhref\s*=\s*[\"'']?([^\s>\"'']+)[\"'']?[^>]*\brel\s*=\s*[\"'']?canonical\b"
    refresh = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*\burl\s*=\s*''?([^\"''>\s]+)"
    # Absolute targets only: pages of this form link to whole urls.
    return f"""WITH RECURSIVE rules(h, p, v) AS (VALUES {rules}), targets AS (SELECT url, unnest([regexp_extract(html, '{link}', 1), regexp_extract(html, '{turned}', 1), regexp_extract(html, '{refresh}', 1)]) AS target FROM pages),
e AS (SELECT DISTINCT {node('url')} AS u, {node('target')} AS v FROM targets WHERE target LIKE '%://%'), both_ways AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM both_ways UNION SELECT r.a, w.v FROM reach r JOIN both_ways w ON w.u = r.b), nodes AS (SELECT DISTINCT u AS node FROM both_ways), np AS ({split('nodes', 'node', 'node')}), nb AS ({best('np', 'node')}),
aliases AS (SELECT DISTINCT r.a AS node FROM reach r JOIN nb ON nb.node = r.b WHERE nb.verdict = 'block'), pg AS ({split('pages', 'url', 'page_id, url')}), pb AS ({best('pg', 'page_id')})
SELECT pg.page_id, host, path, rule, coalesce(verdict, CASE WHEN {node('url')} IN (SELECT node FROM aliases) THEN 'block' ELSE 'allow' END) AS verdict FROM pg LEFT JOIN pb ON pb.page_id = pg.page_id"""


def _contained_sql() -> str:
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
    cut = lambda table, key: f"SELECT DISTINCT {key}, list_slice(w, i, i + {decontaminate.WIDTH - 1}) AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {decontaminate.WIDTH - 2}, 2))) AS i FROM {table})"
    return f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS ({cut('(SELECT * FROM d WHERE len(w) > 0)', 'doc_id')}), bs AS ({cut('(SELECT * FROM b WHERE len(w) > 0)', 'item_id')}), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY ALL)
SELECT doc_id, item_id, count(*) / CAST(any_value(n) AS DOUBLE) AS containment FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {decontaminate.CONTAINMENT} * any_value(n)"""


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_TERMS}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{_TERMS}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark),
q AS (SELECT item, item_id, term, CAST(count(*) AS BIGINT) AS times FROM b GROUP BY ALL),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM d WHERE len(terms) > 0),
p AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * CAST(count(*) AS BIGINT) + 1))) AS BIGINT) AS w FROM p, totals GROUP BY term, nd),
s AS (SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), totals GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20"""


#: The other operators need a hash, a tokenizer or a trained model that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_hilbert_shards": _sharding_sql(),
    "op4_quality_rules": _quality_sql(),
    "op6_warc": _WARC_SQL,
    "op8_url_filter": _url_sql(),
    "op10_decontamination": _contained_sql(),
    "op13_ranked_search": _SEARCH_SQL,
}
