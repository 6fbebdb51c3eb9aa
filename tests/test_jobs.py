"""Whole jobs, tables, logs and streams."""

import json
import os

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from shelfwatch.operators import tasks
from shelfwatch.plans import jobs
from shelfwatch.queries.tables import Tables
from shelfwatch.rules.selectors import TEMPLATE_FIELDS
from shelfwatch.session import JOB_CONF
from shelfwatch.sources import attempt_log
from shelfwatch.sources.pages import stream_pages
from shelfwatch.sources.templates import TemplateTable
from shelfwatch.streaming import attempt_streams as st


def shop_page(n):
    items = ",".join(json.dumps({"@type": "Product", "name": f"Item {n} {i}", "offers": {"price": i, "priceCurrency": "USD"}}) for i in range(6))
    return f'<script type="application/ld+json">[{items}]</script>product-title' + "x" * 6000


def test_batch_run(spark, tmp_path):
    rows = [(1, "https://www.ebay.com/sch/i.html", shop_page(1), "none"), (2, "https://www.ebay.com/sch/i.html", shop_page(1), "none"),
            (3, "https://www.walmart.com/search?q=x", "y" * 6000, "none"), (4, "https://www.walmart.com/search?q=x", "access denied" + "y" * 6000, "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, render string")
    out = jobs.batch_run(spark, pages, Tables(spark, DATA).attempts(), str(tmp_path), crawl_date=F.to_date(F.lit("2024-01-01")))
    assert out["products"].count() == 12
    assert [r.page_id for r in out["empty"].collect()] == [3]
    assert out["summary"].first().products_crawled == 12
    assert (tmp_path / "json" / "source=ebay" / "crawl_date=2024-01-01").exists()


def test_example_sets(spark, tmp_path):
    a = Tables(spark, DATA).attempts().select(
        "*", F.col("level").cast("string").alias("initial_level"), *[F.lit(None).cast("string").alias(c) for c in
        ("start_level", "difficulty_hint", "failure_history", "confidence", "reasoning")])
    states = spark.createDataFrame([], "module string, version int, last_built timestamp, last_built_rows long")
    report = jobs.build_example_sets(spark, a, states, F.current_timestamp(), str(tmp_path))
    assert report.filter("ready").count() == 8
    assert spark.read.parquet(str(tmp_path / "module=initial_tier_selector" / "version=1")).count() == a.filter("success").count()


def test_builds_over_a_growing_log(spark, tmp_path):
    """Several builds equal one over the whole log; each reads its own bytes; a lost build is made good by the next."""
    from shelfwatch.operators import examples as ox
    from shelfwatch.plans.example_builds import ExampleBuilds

    log = tmp_path / "log"
    log.mkdir()
    at = lambda hour: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour))
    def land(name, n, bad=0):
        lines = [json.dumps({"site": f"s{i % 3}", "page_pattern": "p", "success": i % 4 > 0, "initial_level": str(i % 5), "trace_id": f"{name}-{i}"}) for i in range(n)]
        (log / name).write_text("\n".join([*lines, "", *["no json"] * bad]) + "\n")
    builds = ExampleBuilds(spark, str(tmp_path / "sets"), str(log))
    ready = lambda hour: {r.module: r.ready for r in builds.build(at(hour)).collect()}
    land("a.jsonl", 40)
    assert not ready(0)["strategy_selector"] and builds.versions().count() == 1  # enough for the level set alone
    land("b.jsonl", 30, bad=1)
    (log / "notes.txt").write_text("no log")
    assert ready(3)["strategy_selector"]
    assert not ready(9)["strategy_selector"]  # nothing new
    land("c.jsonl", 25)
    enter, builds._attempts = builds._attempts, lambda files: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        builds.build(at(12))
    builds._attempts = enter
    land("d.jsonl", 12)
    assert ready(13)["strategy_selector"]
    made = {(r.module, r.version): r for r in builds.versions().collect()}
    sizes = {f: (log / f"{f}.jsonl").stat().st_size for f in "abcd"}
    selector = [made["strategy_selector", v] for v in (1, 2)]
    assert [(r.parent, r.files, r.bytes_read) for r in selector] == [(None, 2, sizes["a"] + sizes["b"]), (1, 2, sizes["c"] + sizes["d"])]
    levels = [made["initial_tier_selector", v] for v in (1, 2, 3)]
    assert [r.bytes_read for r in levels] == [sizes["a"], sizes["b"], sizes["c"] + sizes["d"]]
    assert builds.files().agg(F.sum("lines")).first()[0] == 40 + 31 + 25 + 12
    whole = builds._attempts([str(log / f"{f}.jsonl") for f in "abcd"])
    for module, build in (("strategy_selector", ox.outcome_examples), ("initial_tier_selector", ox.level_examples)):
        columns = build(whole).columns
        assert sorted(map(str, builds.examples(module).select(*columns).collect())) == sorted(map(str, build(whole).collect()))
    assert builds.examples("strategy_selector", 1).count() == selector[0].rows
    land("a.jsonl", 41)
    with pytest.raises(ValueError, match="changed"):
        builds.build(at(20))


def test_task_states(spark):
    events = [("a", "enqueue", 0), ("b", "dequeue", 0), ("c", "failure", 0), ("d", "failure", 2), ("e", "success", 1), ("f", "retry", 2)]
    rows = [(i, t, e, x, 2, "u", "s", "search") for i, (t, e, x) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, task_id string, event string, attempt_index int, config_count int, url string, site string, page_pattern string").withColumn("ts", F.timestamp_seconds("event_id"))
    ledger = tasks.task_ledger(df)
    got = {r.task_id: (r.state, r.current_index, r.fail_count) for r in ledger.collect()}
    assert got == {"a": ("pending", 0, 0), "b": ("running", 0, 0), "c": ("pending", 1, 1), "d": ("failed", 2, 1), "e": ("done", 1, 0), "f": ("pending", 0, 0)}
    assert tuple(tasks.queue_sizes(ledger).first()) == (3, 1, 1)


def test_template_table(spark, tmp_path):
    table = TemplateTable(spark, str(tmp_path / "t"))
    assert not table.exists("amazon")
    fields = [F.lit("h2").alias(f) for f in TEMPLATE_FIELDS]
    keys = spark.createDataFrame([("amazon", "search"), ("ebay", "search")], "site string, page_type string")
    table.save(keys.select("site", "page_type", *fields))
    assert table.exists("amazon") and not table.exists("amazon", "detail")
    table.delete(keys.filter("site = 'amazon'"))
    assert not table.exists("amazon") and [r.site for r in table.sites().collect()] == ["ebay"]


def test_log_reading(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"site": "amazon", "success": true}\n\n')
    (tmp_path / "a.jsonl").write_text('{"site": "ebay", "success": false, "status_code": 403}\nnot json\n')
    (tmp_path / "c.txt").write_text('{"site": "ignored"}\n')
    lines = attempt_log.in_file_order(attempt_log.read_attempts(spark, str(tmp_path))).collect()
    assert [(r.site, r.status_code, r.strategy_tier) for r in lines] == [("ebay", 403, 1), ("", 0, 1), ("amazon", 0, 1)]
    assert lines[1][attempt_log.CORRUPT] == "not json"
    with pytest.raises(Exception):
        attempt_log.read_attempts(spark, str(tmp_path), strict=True).collect()


def test_templates_are_resolved_and_stored_back(spark, tmp_path):
    """Fresh, stale, forced and new keys; a run that was lost after its answer, and one repeated as a whole."""
    table = TemplateTable(spark, str(tmp_path / "t"))
    keys = spark.createDataFrame([("amazon", "search", False, None), ("amazon", "search", None, False), ("x", "detail", True, False)],
                                 "site string, page_type string, has_sample boolean, force boolean")
    made = keys.filter("site = 'x'").select("site", "page_type", *[F.lit(f"new {f}").alias(f) for f in TEMPLATE_FIELDS])
    at = lambda hours: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hours))
    run = lambda hours, **kw: {r.site: (r.origin, r.template.title_selector) for r in table.resolve(kw.pop("keys", keys), kw.pop("generated", made), at(hours), folder=str(tmp_path), **kw).collect()}
    first = run(0)
    assert first["x"] == ("generated", "new title_selector") and first["amazon"][0] == "default" and len(first) == 2
    assert run(1) == {s: ("cached", title) for s, (_, title) in first.items()}
    assert run(23.99) == run(1)
    late = run(24)
    assert late["x"] == ("stored", "new title_selector") and late["amazon"][0] == "default"
    assert run(25)["amazon"][0] == "cached" and run(25)["x"][0] == "stored"
    forced = run(25, keys=keys.withColumn("force", F.lit(True)), generated=None)
    assert forced["x"][0] == "default" and run(26)["x"][0] == "cached"
    store, table._overwrite = table._overwrite, lambda rows: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        run(60)
    table._overwrite = store
    again = run(60)
    assert again["x"][0] == "stored" and again["amazon"][0] == "default"
    assert run(60.5)["amazon"][0] == "cached" and table.all().count() == 2
    assert table.resolve(keys.filter("false"), folder=str(tmp_path)).count() == 0


def test_streamed_state_over_several_batches(spark, tmp_path):
    """State carries over between batches and merges to what one batch over all rows gives."""
    rows = Tables(spark, DATA).attempts().withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", JOB_CONF["spark.sql.streaming.stateStore.providerClass"])
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = st.append_parquet(st.metrics_state(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.lastProgress["batchId"] >= 2
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    from shelfwatch.operators.attempts import site_metrics

    got = {r.site: (r.success_count, r.failure_count, round(r.avg_response_time, 6)) for r in st.merged_metrics(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {r.site: (r.success_count, r.failure_count, round(r.avg_response_time, 6)) for r in site_metrics(rows).collect()}
    assert got == want


def test_late_rows_are_counted(spark, tmp_path):
    schema = "ts timestamp, site string, block_type string, latency_ms double"
    for i, day in enumerate(["2024-01-05", "2024-01-09", "2024-01-01"]):
        spark.createDataFrame([(None, "s", "none", 1.0)], schema).withColumn("ts", F.to_timestamp(F.lit(day))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = st.append_parquet(st.windowed_stats(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert st.dropped_rows(query) == 1


def test_distinct_rows_with_a_short_delay(spark, tmp_path):
    """A key comes again once a batch has cleared its expired row; a suppressed row does not prolong that."""
    (tmp_path / "in").mkdir()
    for n, minutes in enumerate([[("k", 0)], [("k", 50)], [("x", 125)], [("z", 126)], [("k", 130)], [("y", 400)]]):
        rows = spark.createDataFrame(minutes, "url string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60 + 1_700_000_000))
        rows.coalesce(1).write.parquet(str(tmp_path / f"made{n}"))
        file = next((tmp_path / f"made{n}").glob("part-*"))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # a stream takes files by their times
        file.rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema("url string, m int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = st.append_parquet(st.distinct_within(stream, "ts", ["url"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted((r.url, r.m) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("k", 0), ("k", 130), ("x", 125), ("y", 400), ("z", 126)]


def test_log_and_page_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"site": "amazon", "success": true, "timestamp": "2024-01-01T00:00:00"}\n\n{"site": "ebay"}\n')
    query = st.append_parquet(st.stream_attempts(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("site").collect()
    assert [(r.site, r.strategy_tier, str(r.event_time)) for r in rows] == [("amazon", 1, "2024-01-01 00:00:00"), ("ebay", 1, "None")]
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    pages.write.parquet(str(tmp_path / "pages"))
    landed = stream_pages(spark, str(tmp_path / "pages"), pages.schema)
    query = st.append_parquet(jobs.classified(landed).drop("headers"), str(tmp_path / "verdicts"), str(tmp_path / "check2"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "verdicts")).count() == pages.count()
