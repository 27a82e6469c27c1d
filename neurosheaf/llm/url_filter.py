"""URL filters with redirect equivalence, with DataFrame functions only.

Rules name a host and the start of a path; the longest that fits a url decides. Urls joined by redirect
or canonical-link edges are the same page under several names: connected components over those edges
carry a block decision to all aliases. A rule of a url's own goes before what its aliases say, so an
explicit allow holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, dealt, fresh
from .components import connected_components


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # "allow" or "block"

    @property
    def name(self) -> str:
        return self.host + self.path


#: A longer list is joined by host instead of being tried rule by rule.
LISTED = 256
#: Kinds of alias edges in a page, and the attribute that has the other url.
_QUOTED = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref" + _QUOTED
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*'?([^\"'>\s]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


_RULE = "struct<length:int,allow:boolean,name:string>"


def _best_listed(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as a struct of its length, whether it allows, and its name; an allow before a block of equal length."""
    fitting = []
    for r in rules:
        of_host = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        found = F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.verdict == "allow").alias("allow"), F.lit(r.name).alias("name"))
        fitting.append(F.when(of_host & F.startswith(path, F.lit(r.path)), found))
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast(_RULE)


def match_rules(urls: DataFrame, rules: list[UrlRule] | DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path and best (struct length, allow, name; null where no rule fits) to every row.

    ``rules`` is a list, or a DataFrame (host, path, verdict) of any size: then the distinct pairs of host
    and path are joined with the rules of the host and of each domain above it. Null urls and urls
    without ``://`` have an empty host and path, which no rule fits but one for the empty host.
    """
    parts = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if isinstance(rules, list) and len(rules) <= LISTED:
        return parts.withColumn("best", _best_listed(F.col("host"), F.col("path"), rules))
    if isinstance(rules, list):
        rules = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    table = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.struct(F.length(F.concat("host", "path")).alias("length"), (F.col("verdict") == "allow").alias("allow"), F.concat("host", "path").alias("name")).alias("rule"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = parts.select("host", "path").distinct().withColumn("rule_host", F.explode(above))
    fitting = names.join(table, "rule_host").where(F.startswith("path", "rule_path"))
    best = fitting.groupBy("host", "path").agg(F.max("rule").alias("best"))
    of_host, of_path = fresh(parts.columns, "host"), fresh(parts.columns, "path")
    best = best.select(F.col("host").alias(of_host), F.col("path").alias(of_path), "best")
    plain = parts.drop("best")
    return plain.join(dealt(best), (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)), "left").drop(of_host, of_path)


def node_of(url: Column) -> Column:
    """What a url is in the graph of aliases: scheme and host lower-cased, without its fragment. Null without ``://``."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    at = F.instr(bare, "://")
    rest = F.substr(bare, at + 3)
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    return F.when(at > 0, F.concat(ascii_lower(F.substr(bare, F.lit(1), at + 2)), ascii_lower(host), F.substr(rest, F.length(host) + 1)))


def _without_dots(url: Column) -> Column:
    """A url without ``.`` and ``..`` in its path; a ``..`` at the root goes."""
    root, path, rest = (F.regexp_extract(url, r"(?s)^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$", g) for g in (1, 2, 3))
    parts = F.split(path, "/")

    def step(done, part):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    plain = F.concat(F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step), folder)
    return F.when(F.contains(path, F.lit("/.")), F.concat(root, F.array_join(plain, "/"), rest)).otherwise(url)


def resolved(target: Column, base: Column) -> Column:
    """An absolute url for the target of a link: absolute as it is; ``//host``, ``/path``, ``?query`` and names beside the base, with dots taken out of the path."""
    scheme, root = F.regexp_extract(base, r"^([^:/?#]+):", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.when(F.length(bare) > F.length(root), F.regexp_extract(bare, r"(?s)^(.*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(F.trim(target) == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), _without_dots(F.concat(root, target)))
        .when(F.startswith(target, F.lit("?")), F.concat(bare, target))
        .when(target.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(_without_dots(F.concat(folder, target)))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v) from all canonical links and meta refreshes in pages; a page with neither, or null html or url, gives none."""
    html = F.col(html_col)
    kinds = ((_CANONICAL, "link", "canonical", 3), (_REFRESH, "meta", "refresh", 1))
    targets = []
    for pattern, tag_name, word, groups in kinds:
        tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag_name}\b[^>]*"), F.lit(0))
        found = F.transform(tags, lambda tag: F.coalesce(*(F.nullif(F.regexp_extract(tag, pattern, g), F.lit("")) for g in range(1, groups + 1))))  # noqa: B023
        plain = F.transform(found, lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))
        targets.append(F.when(html.rlike(f"(?i){word}"), plain).otherwise(F.array().cast("array<string>")))
    links = pages.select(F.col(url_col).alias("base"), F.explode(F.concat(*targets)).alias("target")).where("target is not null")
    return links.select(node_of(F.col("base")).alias("u"), node_of(resolved(F.col("target"), F.col("base"))).alias("v")).where("u <> v")


def judge(pages: DataFrame, rules: list[UrlRule] | DataFrame, edges: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (name or null), alias_blocked and verdict (allow or block).

    ``edges`` (u, v: urls as node_of gives them) may name urls that no page has; those count by their
    rules too. A url without a rule of its own is blocked if any alias is blocked by one, else allowed.
    Rows with equal urls get equal verdicts; null urls are allowed. Columns of the names added are replaced.
    """
    groups = cut(connected_components(edges.select("u", "v").where("u is not null and v is not null")))
    judged = match_rules(groups, rules, "node")
    blocked = judged.where("best is not null and not best.allow").select("component").distinct()
    # Dealt out once more, so that adaptive execution can split the partition of a component with very many aliases.
    aliases = groups.join(dealt(blocked), "component", "left_semi").select(F.col("node").alias(alias := fresh(pages.columns, "alias")))
    own = pages.drop("host", "path", "best", "rule", "alias_blocked", "verdict")
    matched = match_rules(own, rules, url_col).join(aliases, node_of(F.col(url_col)) == F.col(alias), "left")
    verdict = F.when(F.col("best").isNotNull(), F.col("best.allow")).otherwise(F.col(alias).isNull())
    return matched.withColumns({"rule": F.col("best.name"), "alias_blocked": F.col(alias).isNotNull(), "verdict": F.when(verdict, "allow").otherwise("block")}).drop("best", alias)
