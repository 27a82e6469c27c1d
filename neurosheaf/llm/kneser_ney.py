"""Quality by the perplexity of an interpolated modified Kneser-Ney model of words.

The model is ``word_model``: pairs of words with an unbounded vocabulary, whose table is sharded by hash and
joined with the distinct words and pairs of each document. Documents above a quantile of their language's
trusted perplexities are rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import word_model
from .common import by_ids, cut, fresh

#: Log perplexities are compared in steps of this.
STEP = 0.001
#: Of a language's trusted documents, the share that stays.
KEPT_SHARE = 0.995


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2, and 3 or more, from the number of n-grams counted once to four times."""
    n1, n2, n3, n4 = counts.agg(*(F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4))).first()
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = [(i, a, b) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    # Small or saturated counts can give no estimate: the discount is then half a count.
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else 0.5 for i, a, b in ratios)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that every label calls good and none calls toxic."""
    found = labels.groupBy(id_col).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return found.where("q = 1 and t = 0").select(id_col)


def language_thresholds(scored: DataFrame, trusted: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", share: float = KEPT_SHARE) -> DataFrame:
    """(language, threshold): the quantile of trusted log perplexities, exact to STEP, from counts of every step."""
    own = scored.join(trusted, id_col, "left_semi").where("log_perplexity is not null")
    language = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    bars = own.groupBy(language.alias("language"), F.ceil(F.col("log_perplexity") / STEP).alias("bar")).agg(F.count("*").alias("m"))
    total = F.sum("m").over(W.partitionBy("language"))
    running = F.sum("m").over(W.partitionBy("language").orderBy("bar"))
    reached = bars.select("language", "bar", (running >= total * share).alias("reached"))
    return reached.where("reached").groupBy("language").agg((F.min("bar") * STEP).alias("threshold"))


def _scored(docs: DataFrame, labels: DataFrame, text_col: str, lang_col: str, id_col: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Scores of all documents without their texts, with the text_key, and the thresholds."""
    trusted = cut(trusted_ids(labels, id_col))
    # One half of the trusted text trains the model, the other sets the thresholds: scores of texts that
    # the model has seen would be too low a bar for those that it hasn't.
    half = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(2))
    training = trusted.where((half == 0) & F.col(id_col).isNotNull())
    model = word_model.Model(by_ids(docs.select(id_col, text_col), training, {id_col: F.col(id_col)}).select(text_col), _discounts)
    scores = cut(word_model.text_scores(docs.select(text_col), model, text_col))
    model.scratch.clear()
    slim = cut(docs.select(id_col, lang_col, word_model.text_key(text_col).alias("text_key")).join(scores, "text_key", "left"))
    return slim, cut(language_thresholds(slim, trusted.where(half == 1), lang_col, id_col, share))


def _judged(scored: DataFrame, limits: DataFrame, lang_col: str, languages: int) -> DataFrame:
    language = fresh(scored.columns, "language")
    limits = limits.withColumnsRenamed({"language": language})
    if limits.count() <= languages:
        limits = F.broadcast(limits)
    judged = scored.join(limits, F.coalesce(F.col(lang_col).cast("string"), F.lit("")) == F.col(language), "left")
    kept = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select(*scored.columns, "threshold", kept.alias("kept"))


def classify_ids(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", share: float = KEPT_SHARE, languages: int = 10_000) -> DataFrame:
    """classify() without the texts and other columns: each text is scored once."""
    slim, limits = _scored(docs, labels, text_col, lang_col, id_col, share)
    return _judged(slim, limits, lang_col, languages).drop("text_key")


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", share: float = KEPT_SHARE, languages: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with all their columns, whatever their names.

    What is rejected comes back by text and language, so rows of one text and language, repeated ones among them, stay or go together; null
    and empty texts stay. Texts that stay aren't moved, but for a few (see common.by_ids). No rows: no rows."""
    slim, limits = _scored(docs, labels, text_col, lang_col, id_col, share)
    gone = _judged(slim, limits, lang_col, languages).where("not kept").select("text_key", F.col(lang_col).alias("lang")).distinct()
    return by_ids(docs, gone, {"text_key": word_model.text_key(text_col), "lang": F.col(lang_col)}, "left_anti")


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", share: float = KEPT_SHARE, languages: int = 10_000) -> DataFrame:
    """``docs`` with log_perplexity, threshold and kept (false: above the threshold of its language).

    Kept as well: null and empty texts, which have no perplexity, and texts of a language without
    trusted documents; a null language is one of its own. Without trusted text everything is kept.
    Thresholds go to all tasks if there are at most ``languages`` of them, else by a join. Scores come
    back by a join on the text's hash.
    """
    slim, limits = _scored(docs, labels, text_col, lang_col, id_col, share)
    key = fresh(docs.columns, "text_key")
    scores = cut(slim.where("log_perplexity is not null").select(F.col("text_key").alias(key), "log_perplexity").dropDuplicates([key]))
    plain = [c for c in docs.columns if c.lower() not in {"log_perplexity", "threshold", "kept"}]
    scored = docs.select(*plain, word_model.text_key(text_col).alias(key)).join(scores, key, "left").select(*plain, "log_perplexity")
    return _judged(scored, limits, lang_col, languages)
