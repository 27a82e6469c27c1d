"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each feature has a fixed ladder of cutoffs, from one that rejects hardly anything to a strict one.
On labelled good documents of a stratum, n of them, a cutoff that rejects k has the exact binomial
p-value P(Bin(n, alpha) <= k) for "its false rejection rate is above alpha". Down the ladder, cutoffs
are accepted as long as the p-value stays at or below delta / (strata * features): fixed-sequence
testing needs no correction along a ladder, and the families share delta by Bonferroni. So with
probability 1 - delta no accepted cutoff rejects more than alpha of the good documents of its
stratum. A family without an accepted cutoff rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_ids, cut, fresh, let

WHITE = r"[\x20\x09-\x0D]"
#: Feature and cutoffs, most lenient first; a document is over a cutoff if its value is greater.
LADDERS: dict[str, list[float]] = {
    "symbols_per_char": [0.5, 0.4, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_line_share": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "repeat_word_share": [0.5, 0.475, 0.45, 0.425, 0.4, 0.375, 0.35, 0.325, 0.3, 0.275, 0.25, 0.225, 0.2, 0.175, 0.15, 0.125],
    "chars_per_word": [40.0, 35.0, 30.0, 27.0, 24.0, 21.0, 19.0, 17.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.5],
}
ALPHA, DELTA = 0.0025, 0.05
#: Terms of the binomial sum below k: what lies further down is under 1e-16 of it.
TAIL = 40
#: Up to so many different repeated windows, positions are looked up in their list; else all windows are sorted.
LOOKED_UP = 32
#: The table of cutoffs, one row a stratum, is broadcast up to so many of them.
BROADCAST_STRATA = 10_000


def _flagged_words(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more, from the windows' hashes in order."""

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(positions, start, lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(p - s["at"], F.lit(3))).alias("n")))["n"]

    def looked_up(twice: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i))
        return covered(F.filter(marked, lambda p: p.isNotNull()))

    def by_sorting() -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a, b):
            return F.coalesce(a["h"] == b["h"], F.lit(False))

        def repeated(s):
            kept = F.filter(s, lambda x, i: same(x, F.try_element_at(s, i + 2)) | ((i > 0) & same(x, F.get(s, i - 1))))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        return covered(let(pairs, repeated))

    def twice(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda h, i: (i > 0) & (h == F.get(s, i - 1))))

    repeats = let(F.sort_array(hashes), twice)
    return let(repeats, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).when(F.size(t) <= LOOKED_UP, looked_up(t)).otherwise(by_sorting()))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of each whole text.

    Null and empty texts have zeros. Windows of words are compared by 64-bit hashes. Columns of these
    names in ``docs`` are replaced; all others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        ends = F.when(n >= 3, F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(1))))
        windows = F.transform(ends, lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))
        repeated = F.when(n >= 3, let(windows, _flagged_words)).otherwise(F.lit(0).cast("long"))
        return F.struct(n.cast("long").alias("n"), repeated.alias("repeated"))

    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    words = F.array_remove(F.split(text, f"{WHITE}+"), "")
    found = fresh(docs.columns, "words")
    plain = docs.withColumn(found, let(words, of_words))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return plain.withColumns(
        {
            "n_words": F.col(found)["n"],
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": let(lines, dup_lines),
            "n_repeat_words": F.col(found)["repeated"],
        }
    ).drop(found)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_char": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def _n_lines(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, good to 1e-13 relative."""
    x = n.cast("double") + 8.0
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    shifted = (x + 0.5) * F.ln(x) - x + 0.9189385332046727 + series
    steps = (n.cast("double") + 1) * (n + 2) * (n + 3) * (n + 4) * (n + 5) * (n + 6) * (n + 7) * (n + 8)
    return shifted - F.ln(steps)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from k down over terms that matter (for k below the mean; above it, 1)."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    most = F.least(k, F.lit(TAIL) + F.lit(12) * F.ceil(F.sqrt(k)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s, j):  # from j successes to one less
        term = s["term"] * j / (n - j + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    down = F.when(most > 0, F.transform(F.sequence(F.lit(0).cast("long"), most - 1), lambda i: (k - i).cast("double")))
    total = F.coalesce(F.aggregate(down, start, step)["sum"], F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that every label calls good; null labels say nothing."""
    return labels.where("quality is not null").groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1").select(id_col)


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, text_hash: str | None = None) -> DataFrame:
    """(stratum, feature, cutoff) accepted for each family, from all labelled good documents that pass the base rules.

    ``measured`` has features() and ``stratum``, and with ``text_hash`` a hash of the text; ``labels`` has the id and quality (1: good). An id with
    several labels counts once, and as good only if all say so; null labels say nothing. No labels: no rows. A bound holds for independent
    documents, so rows that repeat an id count once, and so do, by their hash, copies of a text in a stratum.
    """
    good = good_ids(labels, id_col).where(F.col(id_col).isNotNull())
    shares = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(ladder).cast("array<double>").alias("ladder"), ratios()[f].alias("value")) for f, ladder in LADDERS.items()))
    held = measured.where(~base_failed()).join(good, id_col, "left_semi")
    copy = (F.col(text_hash) if text_hash else F.xxhash64(F.col(id_col))).alias("copy")
    held = held.select(F.col(id_col).alias("id"), copy, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), shares.alias("shares"))
    held = held.groupBy("id").agg(F.min(F.struct("copy", "stratum", "shares")).alias("x")).groupBy("x.copy", "x.stratum").agg(F.min("x.shares").alias("shares")).select("stratum", F.explode("shares").alias("x"))
    # How many cutoffs of the ladder, strictest first, a document's value is over.
    over = F.size(F.filter("x.ladder", lambda c: F.col("x.value") > c))
    counted = held.select("stratum", "x.feature", "x.ladder", over.alias("over")).groupBy("stratum", "feature", "ladder", "over").agg(F.count("*").alias("m"))
    family = W.partitionBy("stratum", "feature")
    grouped = counted.groupBy("stratum", "feature", "ladder").agg(F.sum("m").alias("n"), F.collect_list(F.struct("over", "m")).alias("bars"))
    strata = grouped.select("stratum").distinct().count()
    rung = grouped.select("stratum", "feature", "n", "bars", F.size("ladder").alias("size"), F.posexplode("ladder").alias("step", "cutoff"))
    # A value over ``over`` cutoffs is over the strictest ones: those at steps from size - over.
    rejected = F.aggregate("bars", F.lit(0).cast("long"), lambda a, b: a + F.when(b["over"] >= F.col("size") - F.col("step"), b["m"]).otherwise(0))
    tested = rung.withColumn("k", rejected)
    tested = tested.withColumn("p", binomial_cdf(F.col("k"), F.col("n"), alpha))
    refused = F.max((F.col("p") > delta / max(1, strata * len(LADDERS))).cast("int")).over(family.orderBy("step"))
    accepted = tested.withColumn("refused", refused).where("refused = 0")
    return accepted.groupBy("stratum", "feature").agg(F.min("cutoff").alias("cutoff"))


def with_pool(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, text_hash: str | None = None) -> DataFrame:
    """thresholds(), and for families of a stratum without an accepted cutoff those of all strata together.

    Each of the two gets half of ``delta``. A cutoff from the pool keeps alpha over the good documents of all
    strata, not of its own.
    """
    own = thresholds(measured, labels, stratum, id_col, alpha, delta / 2, text_hash)
    pool = thresholds(measured.withColumn(stratum, F.lit("")), labels, stratum, id_col, alpha, delta / 2, text_hash).drop("stratum")
    strata = measured.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")).distinct()
    missing = cut(strata.crossJoin(pool)).join(own.select("stratum", "feature"), ["stratum", "feature"], "left_anti")
    return own.unionByName(missing)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """features() and n_lines."""
    return features(docs, text_col).withColumn("n_lines", _n_lines(text_col))


def verdicts(measured: DataFrame, accepted: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept to measure()'s rows: kept ones aren't base_failed and over no cutoff of their stratum.

    Columns of these two names are replaced; all others pass through."""
    name = {c: fresh(measured.columns, c) for c in ("stratum", "key", *LADDERS)}
    cutoffs = accepted.groupBy(F.col("stratum").alias(name["stratum"])).pivot("feature", list(LADDERS)).agg(F.min("cutoff"))
    cutoffs = cut(cutoffs.select(name["stratum"], *(F.col(f).alias(name[f]) for f in LADDERS)))
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    judged = measured.withColumn(name["key"], F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(cutoffs, F.col(name["key"]) == F.col(name["stratum"]), "left")
    over = F.lit(False)
    for f, value in ratios().items():
        over = over | F.coalesce(value > F.col(name[f]), F.lit(False))
    failed = base_failed()
    return judged.withColumns({"base_failed": failed, "kept": ~failed & ~over}).drop(*name.values())


def judge_ids(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """judge() without the texts and other columns: each text is measured once."""
    hashed = fresh([id_col, stratum, text_col], "text_hash")
    slim = cut(measure(docs.select(id_col, stratum, text_col), text_col).withColumn(hashed, F.xxhash64(text_col)).drop(text_col))
    return verdicts(slim, thresholds(slim, labels, stratum, id_col, alpha, delta, hashed), stratum).drop(hashed)


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """``docs`` with features(), n_lines, base_failed and kept.

    A null stratum is one of its own. Every row is judged by itself, so repeated rows get equal
    verdicts. Documents of a stratum without labels are judged by the base rules alone. With ``pooled``, strata too
    small for cutoffs of their own take those of with_pool(). Labelled texts
    are read twice, once for the thresholds and once to be judged; none is shuffled unless very many are labelled.
    """
    good = good_ids(labels, id_col).where(F.col(id_col).isNotNull())
    labelled = by_ids(docs.select(id_col, stratum, text_col), good, {id_col: F.col(id_col)})
    hashed = fresh([id_col, stratum, text_col], "text_hash")
    slim = cut(measure(labelled, text_col).withColumn(hashed, F.xxhash64(text_col)).drop(text_col))
    accepted = with_pool if pooled else thresholds
    return verdicts(measure(docs, text_col), accepted(slim, labels, stratum, id_col, alpha, delta, hashed), stratum)
