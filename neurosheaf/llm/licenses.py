"""Licence scans by ordered signature rules, with DataFrame functions only.

A text is normalised to lower-case words. Rules are looked at only where their keyword occurs, and
none where no rule's does; each such regex then gives intervals. Of overlapping detections, one goes that lies inside
another of the same or a better priority (of equal intervals the rule listed later), and one that holds another of a
better priority. Rows stay where they are: there is no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, fresh, let
from .license_rules import BASE, PHRASE, Rule, rules

#: What separates words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """' word word ' of a text; without words: ' '."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")), F.lit(" "))


def triggers(all_rules: list[Rule]) -> list[str]:
    """The keywords of all rules, without those that hold another: a text with none of them fits no rule."""
    known = {k for r in all_rules for k in r.keywords}
    return sorted(k for k in known if not any(o != k and o in k for o in known))


def _rule_table(all_rules: list[Rule]) -> Column:
    """A literal array of structs. A place begins after a space and ends before one, so neighbours may share it."""
    rows = (
        F.struct(
            F.lit(i).alias("rank"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.array(*map(F.lit, r.also or ("",))).alias("also"), F.lit(f" (?:{r.pattern})(?= )").alias("pattern")
        )
        for i, r in enumerate(all_rules)
    )
    return F.array(*rows)


#: A detection: words from 0, the last one included. ``order`` makes the longest of equal starts sort first.
PLACE = "first:int,order:int,priority:int,rank:int,label:string,weight:double,last:int"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


def _places(text: Column, rule: Column) -> Column:
    """The places of a rule's matches: the pieces between matches and the matches themselves tell the words before each."""

    def walk(found: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<{PLACE}>>)").alias("out"))

        def step(s, match):
            first = s["at"] + _spaces(F.get(between, s["i"]))
            after = first + _spaces(match)
            place = F.struct(first.alias("first"), (-after).alias("order"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight"), (after - 1).alias("last"))
            return F.struct((s["i"] + 1).alias("i"), after.alias("at"), F.concat(s["out"], F.array(place)).alias("out"))

        return F.aggregate(found, start, step)["out"]

    parts = F.struct(F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("f"), F.split(text, rule["pattern"]).alias("b"))
    return let(parts, lambda m: walk(m["f"], m["b"]))


def _resolved(places: Column, base: int, priorities: list[int]) -> Column:
    """Base places, and those that no other suppresses. Two passes over the places in order, each with a number for every priority.

    From the right, shortest first: where the nearest place of each priority ends; one that ends no sooner than one of a
    better priority holds it. From the left, longest first: how far the places so far of each priority reach; one that reaches no
    further than one of its own or a better priority lies inside it. Base places are never suppressed, and suppress what
    lies inside them, but not what holds them: that says more.
    """
    known = F.array(*map(F.lit, priorities))

    def passed(listed: Column, start: int, best, out) -> Column:
        empty = F.expr(f"cast(array() as array<struct<{PLACE},held:boolean>>)")

        def step(s, p):
            at = F.array_position(known, p["priority"]).cast("int")
            ends = F.transform(s["ends"], lambda e, i: F.when(i + 1 == at, best(e, p["last"])).otherwise(e))
            return F.struct(ends.alias("ends"), out(s["out"], s["ends"], at, p).alias("out"))

        return F.aggregate(listed, F.struct(F.array(*(F.lit(start) for _ in priorities)).alias("ends"), empty.alias("out")), step)["out"]

    def with_held(listed, ends, at, p):
        held = F.exists(F.slice(ends, 2, F.greatest(at - 2, F.lit(0))), lambda e: e <= p["last"])
        return F.concat(listed, F.array(p.withField("held", held)))

    def without_suppressed(listed, ends, at, p):
        inside = F.exists(F.slice(ends, F.lit(1), at), lambda e: e >= p["last"])
        kept = (p["rank"] < base) | ~(p["held"] | inside)
        return F.when(kept, F.concat(listed, F.array(p))).otherwise(listed)

    judged = passed(F.reverse(F.array_sort(places)), 1 << 30, F.least, with_held)
    resolved = passed(F.reverse(judged), -1, F.greatest, without_suppressed)
    # Most texts have one place at most.
    return F.when(F.size(places) > 1, resolved).otherwise(F.transform(places, lambda p: p.withField("held", F.lit(False))))


def scan(docs: DataFrame, text_col: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """Adds n_words, found (array of struct first, last, rank, label, weight: all base places and the
    detections left after suppression, in order of place) and score (the largest weight, 0 without).

    Null and empty texts have no words and nothing found. Rows with equal texts get equal results, and
    all other columns pass through; n_words, found and score of ``docs`` are replaced.
    """
    used = all_rules or rules()
    table, base = _rule_table(used), len(BASE)
    norm = fresh([*docs.columns, "n_words", "found", "score"], "norm")
    words = docs.withColumn(norm, normalised(F.col(text_col)))
    gate = let(F.lower(norm), lambda s: reduce(or_, (F.contains(s, F.lit(t)) for t in triggers(used))))

    def detections(text: Column) -> Column:
        def resolved(found: Column) -> Column:
            return _resolved(found, base, sorted({r.priority for r in used}))

        def without_phrases(found: Column) -> Column:
            """Phrases that stand in notices of most licences say something only where nothing else does."""
            return F.when(F.exists(found, lambda p: p["priority"] < PHRASE), F.filter(found, lambda p: p["priority"] < PHRASE)).otherwise(found)

        tried = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(text, k)) & F.exists(r["also"], lambda k: F.contains(text, k)))
        kept = let(let(F.flatten(F.transform(tried, lambda r: _places(text, r))), resolved), without_phrases)
        return F.transform(kept, lambda p: F.struct(*(p[c].alias(c) for c in ("first", "last", "rank", "label", "weight"))))

    # A text of words has a space on each side of each; one without is a space or two.
    count = F.when(F.trim(norm) == "", F.lit(0)).otherwise(_spaces(F.col(norm)) - 1).cast("long")
    found = F.when(gate, let(F.translate(norm, ASCII_UPPER, ASCII_LOWER), detections))
    none = F.expr("cast(array() as array<struct<first:int,last:int,rank:int,label:string,weight:double>>)")
    out = words.withColumns({"n_words": count, "found": F.coalesce(found, none)}).drop(norm)
    return out.withColumn("score", F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0)))


def summarise(scanned: DataFrame) -> DataFrame:
    """Adds n_base, first_word, last_word, base_labels and labels to what ``scan`` gives."""
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    starts = F.transform(base, lambda x: x["first"].cast("long"))
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return scanned.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": labels(base),
            "labels": labels(F.col("found")),
        }
    )
