"""Readers, page extraction, table maintenance."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rosterlake.rules import signals
from rosterlake.session import fresh_path
from rosterlake.sinks import exports, tables
from rosterlake.sources import landed, manifests, pages

HTML = {
    1: '<html><head><meta name="description" content=" About it "></head><body><p>outside</p><main><p>in main</p></main>'
       '<article><h1>T</h1><p>First <b>bold</b> text<br>here<p>second</p></article>'
       '<a href="http://github.com/x/y">h</a><a href="https://github.com/own/repo/issues">s</a></body></html>',
    2: '<meta property="og:description" content="og"><main><p>  </p><p>not first</p></main><p>tail</p>'
       '<a href="https://mcpservers.org/x">self</a><a href="/rel">r</a><a href="https://home.example/">home</a>',
    3: '<p>only &amp; this</p><script>var p="<p>x</p>"</script><a href="https://github.com/only-owner">o</a>',
    4: "",
}


def test_page_extraction(spark):
    df = spark.createDataFrame(list(HTML.items()), "page_id long, html string")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert got[1]["repo_url"] == "https://github.com/own/repo" and got[1]["homepage"] == ""
    assert got[1]["readme"] == "About it\n\nFirst bold texthere"
    assert got[2]["repo_url"] == "" and got[2]["homepage"] == "https://home.example/"
    assert got[2]["readme"] == "og"  or got[2]["readme"].startswith("og")
    assert got[3]["first_paragraph"] == "only & this" and got[3]["repo_url"] == ""
    assert got[4]["readme"] == ""


def test_labelled_fixtures(spark, tmp_path):
    for label, n in (("positive", 2), ("negative", 3)):
        (tmp_path / label).mkdir()
        for i in range(n):
            (tmp_path / label / f"{i}.json").write_text(json.dumps(
                {"id": f"{label}{i}", "name": "n", "topics": ["a"], "is_mcp_server": label == "positive"}, indent=1))
    got = landed.labelled_fixtures(spark, str(tmp_path)).groupBy("label", "expected").count()
    assert sorted(rows(got)) == [("negative", False, 3), ("positive", True, 2)]


def test_search_file(spark, tmp_path):
    body = {"total_count": 1, "items": [{"id": 7, "name": "n", "html_url": "https://github.com/o/n", "owner": {"login": "o"},
                                         "license": None, "stargazers_count": 3, "pushed_at": "2024-01-02T03:04:05Z"}]}
    (tmp_path / "r.json").write_text(json.dumps(body, indent=2))
    df = landed.search_candidates(landed.read_json(spark, str(tmp_path / "r.json"), landed.SEARCH))
    r = df.first()
    assert (r["license"], r["author"], r["stars"]) == ("", "o", 3) and r["pushed_at"].year == 2024


def test_signals_fall_back_per_list(spark, tmp_path):
    path = tmp_path / "signals.json"
    path.write_text(json.dumps({"company_keywords": ["ACME"], "taiwan_keywords": []}))
    got = landed.load_signals_file(spark, str(path), signals.REGION_SIGNALS)
    assert got["company_keywords"] == ("ACME",) and got["taiwan_keywords"] == signals.REGION_SIGNALS["taiwan_keywords"]
    assert landed.dictionary_table(spark, got).filter("signal_set = 'company_keywords'").count() == 1


def test_toml_section_stops_at_next_header(spark):
    text = '[project]\ncommand = "no"\n[tool.mcp]\n# c\ncommand = "yes"\n[x]\ntransport = "no"'
    m = spark.createDataFrame([(text,)], "t string").select(manifests.parse_pyproject(F.col("t")).alias("m")).first()["m"]
    assert (m["command"], m["transport"]) == ("yes", "")


def test_json_manifest_merges_servers(spark):
    text = json.dumps({"mcpServers": {"b": {"command": "go", "env": {"X": "2", "Y": "3"}, "args": ["q"]},
                                      "a": {"command": "npx", "env": {"X": "1", "Z": "4"}, "args": ["p"]}}, "name": "no"})
    m = spark.createDataFrame([(text,)], "t string").select(manifests.parse_json(F.col("t")).alias("m")).first()["m"]
    assert (m["server_name"], m["command"], m["args"]) == ("b", "go", ["p", "q"])
    assert m["env"] == {"X": "2", "Y": "3", "Z": "4"}


# --- table maintenance -------------------------------------------------------------------

def frame(spark, data):
    return spark.createDataFrame(data, "id string, n int, first_seen int")


def test_upsert_twice_is_once(spark):
    base = frame(spark, [("a", 1, 10), ("b", 2, 20)])
    new = frame(spark, [("b", 5, 99), ("c", 6, 30)])
    once = tables.upsert(base, new, "id")
    twice = tables.upsert(once, new, "id")
    assert sorted(rows(once)) == sorted(rows(twice)) == [("a", 1, 10), ("b", 5, 20), ("c", 6, 30)]


def test_upsert_reads_both_sides_once(spark):
    base = frame(spark, [("a", 1, 10), ("b", 2, 20), (None, 3, 30)])
    new = frame(spark, [("b", 5, 99), ("b", 7, 98), ("c", None, None), (None, 6, 60)])
    out = tables.upsert(base, new, "id")
    assert sorted(rows(out), key=str) == sorted([("a", 1, 10), ("b", 5, 20), ("b", 7, 20), (None, 3, 30), ("c", None, None), (None, 6, 60)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 2


def test_insert_or_ignore_and_delete(spark):
    base = frame(spark, [("a", 1, 1)])
    more = frame(spark, [("a", 9, 9), ("b", 2, 2)])
    assert sorted(rows(tables.insert_new(base, more, "id"))) == [("a", 1, 1), ("b", 2, 2)]
    assert rows(tables.delete(more, base, "id")) == [("b", 2, 2)]


def test_appended_batches(spark):
    path = fresh_path(spark, "t")
    tables.append_batch(frame(spark, [("a", 1, 10), ("b", 1, 20)]), path, 0)
    for _ in range(2):  # a replayed batch replaces itself
        tables.append_batch(frame(spark, [("a", 2, 99), ("c", 1, 30)]), path, 1)
    state = lambda: sorted(rows(tables.current(spark.read.parquet(path), "id", ["n"]).select("id", "n", "first_seen")))
    assert state() == [("a", 2, 10), ("b", 1, 20), ("c", 1, 30)]
    tables.append_batch(frame(spark, [("b", 7, 1)]), path, 2)
    assert state() == [("a", 2, 10), ("b", 7, 20), ("c", 1, 30)]


def test_backup_only_once(spark):
    path = fresh_path(spark, "backup")
    assert tables.backup_once(spark, frame(spark, [("a", 1, 1)]), path)
    assert not tables.backup_once(spark, frame(spark, [("b", 1, 1)]), path)
    assert spark.read.parquet(path).first()["id"] == "a"


def test_history_files(spark):
    path = fresh_path(spark, "hist")
    for run in ("r1", "r2"):
        tables.append_history(frame(spark, [("a", 1, 1)]).withColumn("crawl_id", F.lit(run)), path)
    assert spark.read.parquet(path).groupBy("crawl_id").count().count() == 2


def test_view_files(spark, sf_dir):
    from rosterlake.plans.q_views import registry_rows
    path = fresh_path(spark, "views")
    df = registry_rows(spark, sf_dir).select("id", "name", "primary_class", "identity_status", "region_level", "security_status")
    exports.write_views(df, path)
    got = spark.read.json(path)
    assert got.filter("view = 'taiwan-ai-ecosystem'").count() == df.filter("region_level >= 'T1'").count()


# --- streams over several micro-batches -------------------------------------------------------

def arrivals(spark, sf_dir, parts=3):
    """The events table split by time into files that arrive one after another."""
    import os
    import time
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = fresh_path(spark, "arrivals")
    cuts = events.agg(*[F.percentile_approx("event_id", i / parts).alias(str(i)) for i in range(1, parts)]).first()
    bounds = [-1, *cuts, 1 << 60]
    for i in range(parts):
        part = events.filter((F.col("event_id") > bounds[i]) & (F.col("event_id") <= bounds[i + 1]))
        staged = fresh_path(spark, "part")
        part.coalesce(1).write.parquet(staged)
        name = next(n for n in os.listdir(staged) if n.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        os.link(f"{staged}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (time.time() - 100 + i * 10,) * 2)
    return events, folder


def test_rate_stream_over_batches(spark, sf_dir):
    from rosterlake.operators import rates
    from rosterlake.streaming import jobs
    events, folder = arrivals(spark, sf_dir)
    stream = jobs.file_stream(spark, folder, events.schema, per_trigger=1)
    got = jobs.run_available(jobs.rate_stream(stream, "user_id", "ts", "event_id", 2, 86400), fresh_path(spark, "rates"))
    want = rates.request_verdicts(events, "user_id", "ts", "event_id", 2, 86400, 5)
    assert sorted(rows(got.select("event_id", "allowed"))) == sorted(rows(want.select("event_id", "allowed")))


def test_upsert_stream_over_batches(spark, sf_dir):
    from rosterlake.streaming import jobs
    events, folder = arrivals(spark, sf_dir)
    stream = jobs.file_stream(spark, folder, events.schema, per_trigger=1).select("user_id", "event_id", "event_type")
    folder = fresh_path(spark, "ents")
    for _ in range(2):  # the second run finds nothing new
        jobs.append_stream(stream, folder).awaitTermination()
    log = spark.read.parquet(folder)
    assert log.select("batch").distinct().count() == 3 and log.count() == events.count()
    want = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(rows(tables.current(log, "user_id", ["event_id"], ()).select("user_id", "event_id"))) == sorted(rows(want))


def test_late_rows_are_reported(spark, tmp_path):
    import os
    import time

    import pytest
    from rosterlake.streaming import jobs
    for n, day in ((0, 20), (1, 21), (2, 2)):
        df = spark.createDataFrame([(n, f"2024-01-{day:02d} 00:00:00")], "k long, t string").selectExpr("k", "cast(t as timestamp) ts")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (part,) = [f for f in os.listdir(tmp_path / f"w{n}") if f.startswith("part")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.link(tmp_path / f"w{n}" / part, tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (time.time() - 100 + n * 10,) * 2)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), df.schema, per_trigger=1)
    kept = jobs.dedupe_stream(stream, ["k"], "ts", "1 hour")
    assert jobs.run_available(kept, str(tmp_path / "out")).count() == 2
    with pytest.raises(RuntimeError, match="1 rows came later"):
        jobs.run_available(kept, str(tmp_path / "out2"), allow_late=False)


@pytest.mark.parametrize("warehouse, master, fine", [
    ("file:/tmp/wh", "local[8]", True), ("/tmp/wh", "local", True), ("file:/tmp/wh", "yarn", False), ("/tmp/wh", "spark://host:7077", False),
    ("hdfs://name/wh/", "yarn", True), ("s3a://bucket/wh", "k8s://https://host", True)])
def test_intermediate_folder_is_shared_or_an_error(warehouse, master, fine):
    from rosterlake import session
    if fine:
        assert session.fallback_dir(warehouse, master) == warehouse.rstrip("/") + "/_intermediate"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.fallback_dir(warehouse, master)


def test_gathered_batches(spark, tmp_path):
    """Few folders after many batches, the same state as the whole log, also after replays and a run that broke off."""
    import os
    import random
    import shutil
    rng = random.Random(3)
    schema, made = "id long, seq int, status string, first_seen long, created_at long", {}
    for number in range(14):
        made[number] = [(rng.randrange(12), k, f"{number}-{k}", rng.choice([None, number * 100 + k]), number * 100 + k) for k in range(6)]
    frame = lambda number: spark.createDataFrame(made[number], schema)
    folder = str(tmp_path / "log")
    want = lambda upto: rows(tables.current(spark.createDataFrame(
        [(*r, n) for n in range(upto + 1) for r in made[n]], schema + ", batch long"), "id", ["seq"]).select("id", "seq", "status", "first_seen", "created_at"))
    now = lambda: rows(tables.current(tables.batches(spark, folder), "id", ["seq"]).select("id", "seq", "status", "first_seen", "created_at"))
    for number in range(14):
        tables.append_batch(frame(number), folder, number)
        before = sorted(x for x in os.listdir(folder) if x.startswith("batch="))
        copies = {x: shutil.copytree(f"{folder}/{x}", str(tmp_path / f"{number}-{x}")) for x in before if x != "batch=-1"}
        if tables.compact(spark, folder, "id", ["seq"], threshold=4):
            assert [x for x in os.listdir(folder) if x.startswith("batch=")] == ["batch=-1"]
            assert spark.read.parquet(f"{folder}/batch=-1").count() <= 12 * 3
            if number == 7:      # broke off before it deleted the batches
                for x, copy in copies.items():
                    shutil.copytree(copy, f"{folder}/{x}")
        assert sorted(now(), key=str) == sorted(want(number), key=str)
        assert sum(x.startswith("batch=") for x in os.listdir(folder)) <= 5
    for number in (2, 13, 5):    # replayed
        tables.append_batch(frame(number), folder, number)
        assert sorted(now(), key=str) == sorted(want(13), key=str)
