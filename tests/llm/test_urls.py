"""URL filters: rules against a plain reading, propagation against a small union-find, and the SQL."""

import random
import re

import duckdb
import pytest
from check_oracles import compare

from rosterlake.llm import urls
from rosterlake.llm.book import load

QUERIES, ORACLES = load()
NAME = "op3_url_filters"
PAGES = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(url):
    host, path = parts(url)
    best = None
    for verdict, rhost, rpath in urls.RULES:
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath) and (best is None or len(rhost + rpath) > len(best[0])):
            best = (rhost + rpath, verdict)
    return best or (None, None)


URLS = [
    "http://com/", "http://com", "http://a.com/x", "http://xcom/", "http://EXAMPLE.com/en/1", "http://www.Example.COM/en/", "http://www.example.com/en",
    "http://m.www.example.com/en/x?y=/z", "http://a.net/es/", "http://net/fr/#x", "http://a.net/ES/", "http://a.net?/es/", "http://a.net#/es/", "http://a.net:80/es/",
    "nothing", "", None, "://net/es/x", "a://b://net/es/", "http://é.net/fr/ü", "//net/es/", "http://net/es/\nx", "http://user@net/es/", "http:///es/",
]


def test_oracle(spark, duck, sf_dir):
    verdict, _, ok = compare(spark, duck, sf_dir, NAME, QUERIES[NAME], ORACLES[NAME])
    assert ok, verdict


def test_rules_alone(spark):
    pages = spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(URLS)], PAGES)
    got = {r.page_id: r for r in urls.filtered(pages).collect()}
    for i, u in enumerate(URLS):
        rule, verdict = rule_of(u)
        assert (got[i].host, got[i].path) == parts(u), u
        assert (got[i].rule, got[i].verdict) == (rule, verdict or "allow"), u


LINKS = [
    '<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', '<link rel="stylesheet" href="{}">',
]


@pytest.mark.parametrize("seed", range(3))
def test_propagation(spark, seed):
    rng = random.Random(seed)
    pool = [f"http{rng.choice(['', 's'])}://{h}/{p}/{k}" for h in ("a.net", "b.org", "c.net", "d.com", "example.com") for p in ("en", "es", "x") for k in range(3)]
    pages, alias = [], {}

    def find(k):
        while alias.setdefault(k, k) != k:
            k = alias[k]
        return k
    node = lambda u: u.split("://", 1)[1]
    ends = set()
    for i in range(40):
        u, v, form = rng.choice(pool), rng.choice(pool), rng.choice(LINKS + ["<p>{}"])
        pages.append((i, u, "<html>" + form.format(v)))
        if "stylesheet" not in form and "<p>" not in form:
            alias[find(node(u))] = find(node(v))
            ends |= {u, v}
    verdicts = {}
    for u in ends:
        verdicts.setdefault(find(node(u)), set()).add(rule_of(u)[1])
    df = spark.createDataFrame(pages, PAGES)
    got = {r.page_id: r.verdict for r in urls.filtered(df).collect()}
    for i, u, _ in pages:
        inherited = verdicts.get(find(node(u)), set())
        want = rule_of(u)[1] or ("allow" if "allow" in inherited else "block" if "block" in inherited else "allow")
        assert got[i] == want, (u, inherited)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    sql = con.sql(ORACLES[NAME])
    at = [sql.columns.index(c) for c in ("page_id", "verdict")]
    assert {r[at[0]]: r[at[1]] for r in sql.fetchall()} == got


def test_redirect_table_and_precedence(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", None), (2, "http://y.org/b", ""), (3, "http://z.org/c", "x")], PAGES)
    redirects = spark.createDataFrame([("http://x.org/a", "http://n.net/es/1"), ("http://y.org/b", "http://n.net/es/2"),
                                       ("http://n.net/es/2", "http://ok.com/"), (None, "http://z.org/c"), ("http://z.org/c", None)], "url string, target string")
    got = {r.page_id: r.verdict for r in urls.filtered(pages, redirects=redirects).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_empty_null_and_extra_columns(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.net/es/", '<link rel="canonical" href="/en/">'), (1, "http://a.net/es/", "")], PAGES)
    for name in ("host", "node", "rule", "verdict", "component", "u", "v"):
        pages = pages.withColumn(name, F.lit("q"))
    got = sorted(((r.page_id is None, r.verdict) for r in urls.filtered(pages).collect()))
    assert got == [(False, "block"), (False, "block"), (True, "allow")]
    assert urls.filtered(pages.limit(0)).collect() == []


def test_relative_targets_and_entities(spark):
    base = "http://x.org/a/b/c?q=1#f"
    want = {"page.html": "http://x.org/a/b/page.html", "../x": "http://x.org/a/x", "?id=2": "http://x.org/a/b/c?id=2", "/y/./z/../w": "http://x.org/y/w",
            "//n.net/es/1": "http://n.net/es/1", "/a?x=1&amp;y=2": "http://x.org/a?x=1&y=2", "/a?x=1&#38;y=3": "http://x.org/a?x=1&y=3",
            "https://h.org/../k": "https://h.org/../k", "mailto:a@b.org": None}
    for form in LINKS[:3]:
        pages = spark.createDataFrame([(i, base, form.format(t)) for i, t in enumerate(want)], PAGES)
        assert sorted(r.target for r in urls.alias_edges(pages).collect()) == sorted(t for t in want.values() if t), form
    pages = spark.createDataFrame([(1, "http://a.net/es/1", '<link rel="canonical" href="../x?a=1&amp;b=2">'), (2, "http://a.net/x?a=1&b=2", "")], PAGES)
    assert {r.page_id: r.verdict for r in urls.filtered(pages).collect()} == {1: "block", 2: "block"}


SAME = ["https://alias.org", "https://alias.org/", "http://alias.org:80", "https://ALIAS.org:443/", "https://alias.org:/#top", "//x"]


def test_spellings_of_one_url(spark, tmp_path):
    import duckdb
    pages = [(k, u, "") for k, u in enumerate(SAME[:5])] + [(10, "http://a.net/es/1", '<link rel="canonical" href="https://alias.org">'),
             (11, "https://b.org/%7euser/%41%2fx%zz", ""), (12, "http://a.net/fr/2", '<link rel="canonical" href="http://b.org/~user/A%2Fx%zz">'),
             (13, "http://c.org?q=1", ""), (14, "http://a.net/fr/3", '<link rel="canonical" href="http://c.org/?q=1">'), (15, "http://alias.org:8080/", "")]
    df = spark.createDataFrame(pages, PAGES)
    got = {r.page_id: r.verdict for r in urls.filtered(df).collect()}
    assert got == {**{k: "block" for k in range(5)}, 10: "block", 11: "block", 12: "block", 13: "block", 14: "block", 15: "allow"}
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    verdict, _, ok = compare(spark, con, str(tmp_path), NAME, QUERIES[NAME], ORACLES[NAME])
    assert ok, verdict


def test_table_of_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "org", "x.y.org", "y.org"]
    paths = ["", "/", "/en/", "/en/a", "/es/", "/x", "/xy/z"]
    made = {(h, p): rng.choice(["allow", "block"]) for h in hosts for p in paths if rng.random() < 0.5}
    rules = [urls.Rule(v, h, p) for (h, p), v in made.items()]
    pages = [(k, f"http://{rng.choice(['', 'm.', 'www.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'a', '1'])}", rng.choice(LINKS).format("http://y.org/xy/z"))
             for k in range(120)] + [(500, None, None), (501, "nothing", ""), (502, "http://.net/es/", "")]
    df = spark.createDataFrame(pages, PAGES)
    table = spark.createDataFrame([*rules, ("block", None, "/"), ("allow", rules[0].host, rules[0].path)], "verdict string, host string, path string")
    rules[0] = rules[0]._replace(verdict="allow")
    want = sorted(map(str, urls.filtered(df, rules).collect()))
    assert sorted(map(str, urls.filtered(df, table).collect())) == want
    assert urls.filtered(df, table.limit(0)).filter("rule is not null").count() == 0
