"""Streams over the event table, run to the end of what is there."""

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwatch.queries.lookup_queries import CACHED_SQL
from shelfwatch.queries.product_queries import DEDUP_SQL, copies
from shelfwatch.queries.tables import ATTEMPTS, Tables
from shelfwatch.session import JOB_CONF, work_folder
from shelfwatch.streaming import attempt_streams as st
from shelfwatch.streaming import value_streams as vs
from shelfwatch.streaming.batch_ledger import BatchLedger, with_ledger
from shelfwatch.streaming.product_streams import KeptProducts, distinct_products

A = f"WITH a AS ({ATTEMPTS})"


def _stream(t: Tables):
    """The event file as a stream, shaped like the attempt table."""
    # A pattern, because a stream takes a single file only by one; a folder of that name works too.
    source = t.spark.readStream.schema(t("events").schema).parquet(f"{t.sf_dir}/event[s].parquet")
    return t.view(ATTEMPTS, "events", source)


def _run(t: Tables, name: str, stream):
    folder = work_folder(t.spark, name)
    query = st.append_parquet(stream, f"{folder}/rows", f"{folder}/checkpoint")
    query.awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows")


@contextmanager
def _keyed_state(t: Tables, **more: str):
    """Keyed list state needs the RocksDB store. The session's own settings come back afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": JOB_CONF["spark.sql.streaming.stateStore.providerClass"], **more}
    before = {key: t.spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        t.spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            t.spark.conf.set(key, value)


def _run_state(t: Tables, name: str, variable: str, build):
    """The state table after the stream's end. State with a time to live would ask for empty batches without end."""
    checkpoint = f"{work_folder(t.spark, name)}/checkpoint"
    with _keyed_state(t, **{"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        st.keep_state(build(_stream(t)), checkpoint).awaitTermination()
    return st.state_table(t.spark, checkpoint, variable)


def _landed(t: Tables, folder: str, rows, pieces: int, run):
    """Let the rows arrive piece by piece (column piece): after each landing run(stream) takes the new files."""
    schema = rows.drop("piece").schema
    for n in range(pieces):
        rows.filter(F.col("piece") == n).drop("piece").write.mode("append").parquet(f"{folder}/landing")
        run(t.spark.readStream.schema(schema).parquet(f"{folder}/landing"))


def appended(t: Tables):
    rows = _run(t, "r1", _stream(t).select("event_id", "site", "success", "latency_ms"))
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"))


def distinct(t: Tables):
    rows = _run(t, "r2", st.distinct_within(_stream(t), "ts", ["url"], "40 days"))
    return rows.select("url").groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def distinct_copies(t: Tables):
    """Products in four landings, in the order of their extraction, deduplicated as they come."""
    folder, row_key = work_folder(t.spark, "r2-products"), ["p_partkey", "copy"]
    rows = copies(t).withColumn("piece", (F.col("copy") - 1) * 2 + F.floor(F.col("p_partkey") % 10 / 5))
    run = lambda stream: distinct_products(stream, f"{folder}/kept", f"{folder}/checkpoint", row_key).awaitTermination()
    _landed(t, folder, rows, 4, run)
    kept = KeptProducts(t.spark, f"{folder}/kept", row_key).rows(rows.drop("piece").schema)
    return kept.select("p_partkey", "copy", "source", "url", "asin")


def metrics(t: Tables):
    m = st.state_metrics(_run_state(t, "r3", "state", lambda stream: st.metrics_state(stream, emit=False)))
    return m.withColumn("avg_response_time", F.round("avg_response_time", 6)).withColumn("success_rate", F.round("success_rate", 6))


def cache(t: Tables):
    def build(stream):
        return st.cached_state(stream.filter("success"), ["site", "page_pattern"], "ts", "event_id", "level", emit=False)

    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return st.merged_cache(_run_state(t, "r4", "held", build), ["site", "page_pattern"], now).select(
        "site", "page_pattern", F.col("value").cast("int").alias("level"))


def streamed_levels(t: Tables):
    """J4 as a stream: attempts in three landings, out of order by up to an hour and a half, look up the last success."""
    folder, keys = work_folder(t.spark, "r4-lookups"), ["site", "page_pattern"]
    a = t.attempts()
    arrived = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp")) / 60_000_000 + F.col("event_id") % 5 * 20
    thirds = F.floor((arrived - F.lit(1_704_067_200 / 60)) / (10 * 24 * 60)).cast("int")
    rows = a.select(*keys, "ts", "event_id", F.lit(True).alias("asks"), F.when(F.col("success"), F.col("level")).alias("level"),
                    F.greatest(F.least(thirds, F.lit(2)), F.lit(0)).alias("piece"))

    def run(stream):
        answers = vs.answered_lookups(stream, keys, "ts", "event_id", "asks", "level", "2 hours", 21600)
        st.append_parquet(answers, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()

    with _keyed_state(t):
        _landed(t, folder, rows, 3, run)
    answers = t.spark.read.parquet(f"{folder}/rows").unionByName(vs.open_lookups(t.spark, f"{folder}/checkpoint", keys, 21600))
    return answers.select(F.col("tie").alias("event_id"), F.col("value").cast("int").alias("level"))


def history(t: Tables):
    state = _run_state(t, "r5", "state", lambda stream: st.history_state(stream, emit=False))
    return st.state_history(state, ["url"], 20).select("url", "history_rank", F.col("row_id").alias("event_id"))


def late_rows(t: Tables):
    """Events in three landings: two halves in time order, then a tenth of all, most of it long past the watermark."""
    folder, a = work_folder(t.spark, "r7"), t.attempts()
    half = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    rows = a.select("event_id", "ts", F.when(F.col("event_id") % 10 == 3, 2).when(F.col("ts") < half, 0).otherwise(1).alias("piece"))
    ledger = BatchLedger(t.spark, f"{folder}/ledger", "r7")

    def run(stream):
        kept = st.distinct_within(stream, "ts", ["event_id"], "1 hour")
        writer = kept.writeStream.queryName("r7").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        with_ledger(ledger, lambda: writer.trigger(availableNow=True).start())

    _landed(t, folder, rows, 3, run)
    arrived = ledger.rows().filter("rows_in > 0")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("batch"))
    return arrived.select(nth.alias("landing"), "rows_in", "rows_dropped")


def windows(t: Tables):
    """All days: those the stream closed, and the last ones, still open when it ended."""
    closed = _run(t, "r6", st.windowed_stats(_stream(t), "ts"))
    rows = closed.unionByName(st.open_windows(t.attempts(), closed, "ts"))
    utc = F.to_utc_timestamp("window_start", F.current_timezone())
    return rows.select(F.date_format(utc, "yyyy-MM-dd").alias("day"), "site", "block_type", "n")


QUERIES = {
    "r1_appended": (appended, f"{A} SELECT site, count(*) AS n, round(sum(latency_ms), 3) AS latency_ms FROM a GROUP BY 1"),
    "r2_distinct_urls": (distinct, f"{A} SELECT DISTINCT url, 1 AS n FROM a"),
    "r2_distinct_products": (distinct_copies, DEDUP_SQL),
    "r3_metrics": (metrics, f"""{A}, c AS (SELECT site, sum(success::INT)::BIGINT AS ok, sum((NOT success)::INT)::BIGINT AS bad, count(*) AS total FROM a GROUP BY 1),
        n AS (SELECT site, avg(latency_ms) / 1000 AS mean FROM (SELECT site, latency_ms, row_number() OVER
              (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE success) x WHERE r <= 50 GROUP BY 1)
        SELECT c.site, round(coalesce(mean, 0.0), 6) AS avg_response_time, round(ok / total, 6) AS success_rate, ok AS success_count,
               bad AS failure_count, total AS total_requests FROM c LEFT JOIN n ON n.site = c.site"""),
    "r4_cached_levels": (cache, f"""{A} SELECT site, page_pattern, level FROM (SELECT *, row_number() OVER
        (PARTITION BY site, page_pattern ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE success) x
        WHERE r = 1 AND TIMESTAMP '2024-01-31 00:00:00' - ts < INTERVAL 24 HOUR"""),
    "r4_j4_streamed_levels": (streamed_levels, f"""{CACHED_SQL} SELECT event_id, CASE WHEN ts - seen_at < INTERVAL 6 HOUR THEN level END AS level FROM w"""),
    "r5_url_history": (history, f"""{A} SELECT url, r::INT AS history_rank, event_id FROM (SELECT *, row_number() OVER
        (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS r FROM a) x WHERE r <= 20"""),
    "r6_windowed_stats": (windows, f"""{A} SELECT strftime(ts, '%Y-%m-%d') AS day, site, block_type, count(*) AS n FROM a
        GROUP BY 1, 2, 3"""),
    "r7_late_rows": (late_rows, f"""{A}, p AS (SELECT ts, CASE WHEN event_id % 10 = 3 THEN 3 WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 2 END AS landing FROM a),
        m AS (SELECT landing, max(ts) AS top FROM p GROUP BY 1),
        w AS (SELECT p.landing, p.ts, (SELECT max(date_trunc('milliseconds', top)) - INTERVAL 1 HOUR FROM m WHERE m.landing < p.landing) AS mark FROM p)
        SELECT row_number() OVER (ORDER BY landing)::INT AS landing, count(*) AS rows_in, count(*) FILTER (ts <= mark) AS rows_dropped FROM w GROUP BY w.landing"""),
}
