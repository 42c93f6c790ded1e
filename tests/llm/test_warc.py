"""Archive derivatives: against the SQL, and by hand on small responses."""

import hashlib

import pytest
from check_oracles import compare
from pyspark.sql import functions as F

from rosterlake.llm import warc
from rosterlake.llm.book import load

QUERIES, ORACLES = load()
NAME = "op2_warc_derivatives"
RESPONSES = "record_id string, target_uri string, date string, block string"
HEAD = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=utf-8\r\nServer: x\r\n\r\n"


def test_oracle(spark, duck, sf_dir):
    verdict, _, ok = compare(spark, duck, sf_dir, NAME, QUERIES[NAME], ORACLES[NAME])
    assert ok, verdict


def records(spark, rows):
    return warc.derivatives(spark.createDataFrame(rows, RESPONSES))


def test_linked_records(spark):
    html = ("<!DOCTYPE html><html lang='de'><head><title> A &amp;\n B </title><style>p{}</style></head><body><nav>menu</nav><h1>Head</h1>"
            "<p>one <b>two</b>&nbsp;three &lt;x&gt;</p><script>var a='<p>';</script><!-- no --><ul><li><a href=1>l</a></ul></body></html>")
    got = {r.type: r for r in records(spark, [("<urn:uuid:1>", "http://a/", "2024-01-02T03:04:05Z", HEAD + html)]).collect()}
    meta, text = got["metadata"], got["conversion"]
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    assert meta.refers_to == text.refers_to == "<urn:uuid:1>" and meta.record_id != text.record_id
    assert text.block == "Head\none two three <x>\nl" and text.content_type.startswith("text/plain")
    assert text.source_headers == "Content-Type: text/html; charset=utf-8\r\nServer: x"
    assert (text.payload_digest, text.source_digest, text.block_digest) == (sha(html), sha(HEAD + html), sha(text.block))
    assert text.content_length == len(text.block.encode())
    lines = dict(line.split(": ", 1) for line in meta.block.strip().split("\r\n"))
    assert lines["http-status"] == "404" and lines["title"] == "A & B" and lines["language"] == "de" and lines["outlinks"] == "1"


def test_serialised(spark):
    df = records(spark, [("<urn:uuid:1>", "http://a/", None, HEAD + "<p>é")])
    for r in warc.serialised(df.filter("type = 'conversion'")).collect():
        head, body = r.record.split("\r\n\r\n", 1)
        assert head.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and "WARC-Refers-To: <urn:uuid:1>" in head
        assert "WARC-Date" not in head and "Content-Length: 2" in head and body == "é\r\n\r\n"


@pytest.mark.parametrize("block", [None, "", "no empty line", "\r\n\r\n", HEAD, "HTTP/1.1 200 OK\r\n\r\n" + "<p>" * 50_000, "HTTP/1.1 200 OK\r\n\r\n<<>><!-- <p", "a\n\nb"])
def test_odd_blocks(spark, block):
    got = records(spark, [(None, None, None, block)] * 2).collect()
    assert len(got) == 4 and len({r.record_id for r in got}) == 2
    assert all(r.block is not None and r.refers_to and r.target_uri is None for r in got)


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F
    assert records(spark, []).collect() == []
    df = spark.createDataFrame([("r", "u", "d", "x")], RESPONSES)
    for name in ("type", "body", "text", "metadata", "record", "refers_to", "content_type"):
        df = df.withColumn(name, F.lit(1))
    assert warc.derivatives(df).count() == 2


REFERENCES = ["caf&eacute; &#8217;x&#x27; &mdash;", "&amp;lt; &amp;amp;lt;", "a&nbsp;b&#160;c", "&bogus; &amp &#; &#x; &;", "&#150;&#x80;&#0;", "&#xD800;&#1114112;&#x1F4A9;",
              "&NotEqualTilde;&Aacute;&aacute;", "&#65&#66;", "x &#x1F600; y", "no references & none", "&lt;b&gt;"]


def test_character_references(spark):
    """As the standard library undoes them, but for the no-break space and names without a semicolon."""
    import html as standard
    import re
    df = spark.createDataFrame([(k, t) for k, t in enumerate(REFERENCES)], "k int, t string")
    got = dict(map(tuple, df.select("k", warc._unescaped(F.col("t"))).collect()))
    for k, t in enumerate(REFERENCES):
        want = re.sub(warc.REFERENCE, lambda m: " " if m[0] in ("&nbsp;", "&#160;") else
                      standard.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in standard.entities.html5 else m[0], t)
        want = want.replace(standard.unescape("&#1114112;"), "\ufffd")
        assert got[k] == want, t


def test_references_in_records_and_sql(spark, stored):
    import duckdb
    from check_oracles import compare
    from rosterlake.llm.book import load
    pages = [(k, "http://a.org/" + str(k), f"<html><title>{t}</title><body><p>{t}</p></body></html>") for k, t in enumerate(REFERENCES)]
    folder = stored(pages=spark.createDataFrame(pages, "page_id long, url string, html string"))
    queries, sql = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    verdict, _, ok = compare(spark, con, folder, "op2_warc_derivatives", queries["op2_warc_derivatives"], sql["op2_warc_derivatives"])
    assert ok, verdict
    blocks = [r.block for r in queries["op2_warc_derivatives"](spark, folder).filter("type = 'conversion'").collect()]
    assert any("café ’x' —" in b for b in blocks)


def test_openers_that_nothing_closes(spark, monkeypatch):
    import time
    parts = ["<p>a</p>", "<!-- c -->", "<!-- open", "<script>x()</script>", "<script", "<head><title>t</title></head>", "<nav>n</nav >", "<nav>", "</script>", "-->", "<scripted>", "<STYLE>s</style>", "<style "]
    import random
    rng = random.Random(1)
    df = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(0, 14))),) for _ in range(400)], "t string")
    plain = [r[0] for r in df.select(warc.plain_text(F.col("t"))).collect()]
    monkeypatch.setattr(warc, "LONG", 0)
    assert [r[0] for r in df.select(warc.plain_text(F.col("t"))).collect()] == plain
    long = spark.createDataFrame([("<!--" * 260_000,), ("<script " * 130_000,), ("x" + "<nav>" * 200_000,)], "t string")
    t = time.time()
    long.select(F.length(warc.plain_text(F.col("t")))).collect()
    assert time.time() - t < 60
