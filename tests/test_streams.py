"""Streams whose result must not depend on how their input is cut."""

import os
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_timeline import in_order

from shelfwatch.operators.attempts import site_metrics
from shelfwatch.queries.tables import Tables
from shelfwatch.session import JOB_CONF
from shelfwatch.streaming import attempt_streams as st
from shelfwatch.streaming import product_streams, value_streams
from shelfwatch.streaming.batch_ledger import BatchLedger, with_ledger
from shelfwatch.streaming.product_streams import KeptProducts, distinct_products

PRODUCT = "n int, source string, url string, asin string, extracted_at string"


def product_rows(seed, n=120):
    rng = random.Random(seed)
    return [(i, f"s{rng.randrange(2)}", rng.choice(["", None, f"u{rng.randrange(40)}"]), rng.choice(["", None, f"a{rng.randrange(30)}"]), f"t{i:04d}") for i in range(n)]


@pytest.mark.parametrize("few", [product_streams.FEW_KEYS, 0])
@pytest.mark.parametrize("cuts", [[120], [1, 2, 60], [30, 60, 90]])
def test_products_are_distinct_however_they_arrive(spark, tmp_path, monkeypatch, cuts, few):
    monkeypatch.setattr(product_streams, "FEW_KEYS", few)
    data, place = product_rows(3), str(tmp_path / "in")
    for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
        if a == b:
            continue
        spark.createDataFrame(data[a:b], PRODUCT).repartition(2).write.mode("append").parquet(place)
        stream = spark.readStream.schema(PRODUCT).parquet(place)
        distinct_products(stream, str(tmp_path / "kept"), str(tmp_path / "check"), ["n"]).awaitTermination(120)
    table = KeptProducts(spark, str(tmp_path / "kept"), ["n"])
    got = table.rows(spark.createDataFrame([], PRODUCT).schema).collect()
    want = in_order([(n, s, u or "", a or "", t) for n, s, u, a, t in data])
    assert sorted(r.n for r in got) == sorted(want)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    data = product_rows(5, 60)
    frame = lambda a, b: spark.createDataFrame(data[a:b], PRODUCT)
    table = KeptProducts(spark, str(tmp_path / "kept"), ["n"])
    table.add(frame(0, 20), 0)
    table.add(frame(20, 40), 1)
    table.add(frame(20, 40), 1)
    table.add(frame(0, 0).union(frame(40, 60)), 2)
    table.add(frame(40, 60), 2)
    want = in_order([(n, s, u or "", a or "", t) for n, s, u, a, t in data])
    assert sorted(r.n for r in table.rows(frame(0, 1).schema).collect()) == sorted(want)


@pytest.fixture
def keyed_state(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": JOB_CONF["spark.sql.streaming.stateStore.providerClass"],
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")


def test_state_size_goes_with_keys_and_not_with_batches(spark, tmp_path, keyed_state):
    rows = Tables(spark, DATA).attempts().withColumn("ts", F.col("ts").cast("timestamp"))
    sizes = {}
    for batches in (3, 6):
        place = tmp_path / str(batches)
        rows.repartition(batches, "event_id").write.parquet(str(place / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(place / "in"))
        query = st.keep_state(st.metrics_state(stream, emit=False), str(place / "check"))
        query.awaitTermination(120)
        assert query.lastProgress["batchId"] == batches - 1
        state = st.state_table(spark, str(place / "check"), "state")
        sizes[batches] = (state.count(), state.agg(F.sum(F.size("micros"))).first()[0])
        got = {r.site: (r.success_count, r.failure_count, round(r.avg_response_time, 6)) for r in st.state_metrics(state).collect()}
        want = {r.site: (r.success_count, r.failure_count, round(r.avg_response_time, 6)) for r in site_metrics(rows).collect()}
        assert got == want
    assert sizes[3] == sizes[6]


def test_state_forms_agree_with_emitted_rows(spark, tmp_path, keyed_state):
    rows = Tables(spark, DATA).attempts().withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.append_parquet(st.history_state(stream()), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    emitted = st.merged_history(spark.read.parquet(str(tmp_path / "out")), ["url"], 20)
    state = st.state_history(st.state_table(spark, str(tmp_path / "check"), "state"), ["url"], 20)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, emitted.collect()))
    keys, now = ["site", "page_pattern"], F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    cached = st.cached_state(stream(), keys, "ts", "event_id", "level")
    st.append_parquet(cached, str(tmp_path / "values"), str(tmp_path / "check2")).awaitTermination(120)
    held = st.merged_cache(st.state_table(spark, str(tmp_path / "check2"), "held"), keys, now, 10**7)
    emitted = st.merged_cache(spark.read.parquet(str(tmp_path / "values")), keys, now, 10**7)
    newest = rows.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "level")).alias("t")).select(*keys, F.unix_micros("t.ts"), F.col("t.level").cast("double"))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, emitted.collect())) == sorted(map(tuple, newest.collect()))


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_lookups_follow_event_time_however_they_arrive(spark, tmp_path, cuts):
    """Values and lookups come up to half an hour late, in files that have nothing to do with keys."""
    rng = random.Random(cuts)
    rows = []
    for i in range(240):
        second = rng.randrange(0, 86_400) // 20 * 20  # ties are common
        rows.append((rng.choice(["hot", "hot", "b", None]), second, i, rng.random() < 0.6, rng.choice([None, float(rng.randrange(9))])))
    ddl = "key string, s int, n long, asks boolean, v double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", JOB_CONF["spark.sql.streaming.stateStore.providerClass"])
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(1800))
    size = -(-len(rows) // cuts)
    for at in range(0, len(rows), size):
        part = spark.createDataFrame(arrival[at : at + size], ddl).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        answers = value_streams.answered_lookups(stream, ["key"], "ts", "n", "asks", "v", "40 minutes", 7200, 2)
        st.append_parquet(answers, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    closed, still = spark.read.parquet(str(tmp_path / "out")), value_streams.open_lookups(spark, str(tmp_path / "check"), ["key"], 7200, str(tmp_path))
    got = {r.tie: (r.key, r.value) for r in closed.unionByName(still).collect()}
    want = {}
    for k, second, n, asks, _ in rows:
        if asks:
            earlier = [(a, m, v) for o, a, m, _, v in rows if o == k and v is not None and (a, m) < (second, n)]
            last = max(earlier, default=None)
            want[n] = (k or "", last[2] if last and second - last[0] < 7200 else None)
    assert got == want
    assert cuts == 1 or closed.count() > len(want) / 2
    held = st.state_table(spark, str(tmp_path / "check"), "held")
    assert held.select(F.sum(F.size("l_micros"))).first()[0] == still.count() and held.select(F.sum(F.size("v_micros"))).first()[0] < 120


def test_late_lookups_and_rows_without_a_time(spark, tmp_path):
    """A row past the watermark is dropped as Spark drops it; one without a time is no row of the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", JOB_CONF["spark.sql.streaming.stateStore.providerClass"])
    schema = "key string, n long, asks boolean, v double, ts timestamp"
    for at, rows in enumerate([[("a", 1, False, 5.0, 0), ("a", 2, True, None, 60)], [("a", 3, True, None, 7200), ("a", 9, True, None, None)], [("a", 4, False, 7.0, 30), ("a", 5, True, None, 50)]]):
        df = spark.createDataFrame(rows, "key string, n long, asks boolean, v double, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        answers = value_streams.answered_lookups(stream, ["key"], "ts", "n", "asks", "v", "10 minutes", 86_400, 1)
        st.append_parquet(answers, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [(r.tie, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 5.0)]
    assert [(r.tie, r.value) for r in value_streams.open_lookups(spark, str(tmp_path / "check"), ["key"], 86_400, str(tmp_path)).collect()] == [(3, 5.0)]


@pytest.mark.parametrize("every", [1, 40])
def test_ledger_of_a_long_run(spark, tmp_path, every):
    """More batches than Spark remembers; every fifth file from the tenth on is long past the watermark."""
    batches = 150 if every > 1 else 12
    (tmp_path / "in").mkdir()
    late = 0
    for n in range(batches):
        old = n >= 10 and n % 5 == 0
        late += 2 * old
        hours = [n - 9, n - 9.5] if old else [n]
        (tmp_path / "in" / f"{n:04d}.json").write_text("".join(f'{{"id": {n * 10 + i}, "s": {int(h * 3600) + 1_700_000_000}}}\n' for i, h in enumerate(hours)))
        os.utime(tmp_path / "in" / f"{n:04d}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("id long, s long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    kept = st.distinct_within(stream.withColumn("ts", F.timestamp_seconds("s")), "ts", ["id"], "1 hour")
    ledger = BatchLedger(spark, str(tmp_path / "ledger"), "long", every)
    other = BatchLedger(spark, str(tmp_path / "other"), "another")
    spark.streams.addListener(other)
    writer = kept.writeStream.queryName("long").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    with_ledger(ledger, lambda: writer.trigger(availableNow=True).start())
    spark.streams.removeListener(other)
    rows = ledger.rows().filter("rows_in > 0").orderBy("batch").collect()
    assert len(rows) == batches and sum(r.rows_dropped for r in rows) == late > 0
    assert [r.rows_dropped for r in rows] == [2 * (n >= 10 and n % 5 == 0) for n in range(batches)]
    marks = [r.watermark for r in rows if r.watermark is not None]
    assert marks == sorted(marks)
    assert not (tmp_path / "other").exists()
