import random
import re

from neurosheaf.llm import url_filter
from neurosheaf.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, best string, verdict string"
URLS = ["http://a.example.com/en/x", "https://www.example.com/en/", "http://WWW.Example.COM/en/y?z", "http://example.com/fr", "http://x.net/es/1", "http://x.net/fr", "http://x.net", "x.net/es/", None, "", "ftp://net/fr/a#b", "http://example.com?q=/en/", "http://notexample.com/en/", "http://com/", "https://a://b.net/es/", "http://é.net/es/ü"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def fitting(url):
    host, path = split(url)
    found = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(found, key=lambda r: len(r.name), default=None)


def test_rules_against_brute_force(spark):
    rng = random.Random(0)
    urls = URLS + ["http://" + ".".join(rng.choices(["www", "example", "com", "net", "A"], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/x", "/fr/?a", "/en#f"]) for _ in range(200)]
    pages = spark.createDataFrame([(i, u, None, "h", "r", "b", "v") for i, u in enumerate(urls)], SCHEMA)
    none = spark.createDataFrame([], "u string, v string")
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in URL_RULES], "host string, path string, verdict string")
    for rules in (URL_RULES, table):
        got = {r.page_id: r for r in url_filter.judge(pages, rules, none).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            rule = fitting(u)
            assert (got[i].host, got[i].path) == split(u)
            assert (got[i].rule, got[i].verdict) == ((rule.name, rule.verdict) if rule else (None, "allow")), u
    assert all(r.verdict == "allow" for r in url_filter.judge(pages, [], none).collect())
    assert url_filter.judge(pages.limit(0), URL_RULES, none).count() == 0


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel=canonical></head></html>'
    turn = lambda u: f"<meta http-equiv='Refresh' content='0; URL={u}'>"
    rows = [
        (1, "http://a.org/1#x", link("http://b.org/2?a=1&amp;b=2")),
        (2, "http://b.org/2?a=1&b=2", turn("http://x.net/es/3")),
        (3, "http://x.net/es/3", ""),
        (4, "http://good.com/4", link("http://x.net/es/3")),
        (5, "http://c.org/5", link("/6")),
        (6, "HTTP://C.org/6", None),
        (7, "http://d.org/dir/7?q", link("8")),
        (8, "http://d.org/dir/8", link("http://never.net/fr/page")),
        (9, "http://e.org/", '<link rel="stylesheet" href="http://x.net/es/3">'),
        (10, None, link("http://x.net/es/3")),
        (11, "http://f.org/a", link("//x.net/es/3")),
        (12, "http://f.org/b", link("mailto:x@x.net") + link("")),
        (13, "http://g.org/a/b/c", link("http://g.org/") + link("http://x.net/es/3")),
        (14, "http://h.org/a/b/c", link("../../../x/./y?q=../z")),
        (15, "http://h.org/x/y?q=../z", link("//x.net/es/3")),
        (16, "http://h.org/k/", link("./../x/..")),
    ]
    pages = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, URL_RULES, url_filter.page_edges(pages)).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 7, 8, 11, 13, 14, 15}


def test_a_hub_of_aliases(spark):
    edges = spark.createDataFrame([(f"http://m{i}.org/", "http://x.net/es/hub") for i in range(500)] + [(None, "x"), ("y", None)], "u string, v string")
    pages = spark.createDataFrame([(i, f"http://m{i % 500}.org/", None, None, None, None, None) for i in range(1000)], SCHEMA)
    assert url_filter.judge(pages, URL_RULES, edges).where("verdict = 'block'").count() == 1000


def test_a_long_chain_and_a_large_hub(spark):
    """Blocks travel along 200 redirects, and to 20,000 aliases of one page."""
    chain = [(f"http://c{i}.org/", f"http://c{i + 1}.org/") for i in range(200)] + [("http://c200.org/", "http://x.net/fr/end")]
    hub = spark.range(20_000).selectExpr("concat('http://h', id, '.org/') u", "'http://x.net/es/hub' v")
    edges = spark.createDataFrame(chain, "u string, v string").union(hub)
    pages = spark.range(20_000).selectExpr("id page_id", "concat('http://h', id, '.org/') url").union(spark.range(201).selectExpr("id + 50000", "concat('http://c', id, '.org/')"))
    pages = pages.union(spark.createDataFrame([(90_000, "http://other.org/")], "page_id long, url string"))
    got = url_filter.judge(pages, URL_RULES, edges)
    assert got.where("verdict = 'allow'").select("page_id").collect() == [(90_000,)]
