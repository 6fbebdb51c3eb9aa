"""Aggregates, histories and task states over the attempt log."""

from pyspark.sql import functions as F

from shelfwatch.operators import attempts as oa
from shelfwatch.operators import tasks as ot
from shelfwatch.queries.tables import ATTEMPTS, TASK_EVENTS, Tables

A = f"WITH a AS ({ATTEMPTS})"


def _time(column="ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _time_sql(column="ts"):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _entries(column):
    """A map of counts as sorted text."""
    pairs = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return F.array_join(pairs, ",")


def attempt_stats(t: Tables):
    return oa.attempt_stats(t.attempts()).withColumn("block_types", _entries("block_types"))


STATS_SQL = f"""{A}, b AS (SELECT string_agg(block_type || '=' || n, ',' ORDER BY block_type) AS block_types
    FROM (SELECT block_type, count(*) AS n FROM a GROUP BY 1) x)
SELECT count(*) AS total, sum(success::INT)::BIGINT AS success, (count(*) - sum(success::INT))::BIGINT AS failed,
       printf('%.1f%%', sum(success::INT) / count(*) * 100) AS success_rate, sum(llm_decision::INT)::BIGINT AS llm_decisions,
       printf('$%.4f', sum(cost_estimate)) AS total_cost_estimate, count(DISTINCT site) AS site_count,
       count(DISTINCT page_pattern) AS pattern_count, (SELECT block_types FROM b) AS block_types FROM a"""


def successful_configs(t: Tables):
    return oa.successful_configs(t.attempts(), "site2", "search").select(
        "event_id", "cfg", F.round("cost_estimate", 9).alias("cost_estimate"))


def successful_configs_all(t: Tables):
    return oa.successful_configs(t.attempts()).groupBy("site", "page_pattern", "cfg").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_estimate"), 6).alias("cost"))


def failed_attempts(t: Tables):
    return oa.failed_attempts(t.attempts()).select("event_id", "site", "url", "block_type")


METRICS_CTE = """c AS (SELECT site, sum(success::INT)::BIGINT AS ok, sum((NOT success)::INT)::BIGINT AS bad, count(*) AS total,
      max(ts) AS last_ts FROM a GROUP BY site),
  n AS (SELECT site, avg(latency_ms / 1000) AS mean FROM (SELECT site, latency_ms, row_number() OVER
      (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE success) x WHERE r <= 50 GROUP BY site),
  m AS (SELECT c.site, coalesce(mean, 0.0) AS mean, ok / total AS rate, ok, bad, total, last_ts FROM c LEFT JOIN n ON c.site = n.site)"""


def _rounded_metrics(df):
    return df.withColumn("avg_response_time", F.round("avg_response_time", 6)).withColumn(
        "success_rate", F.round("success_rate", 6))


def site_metrics(t: Tables):
    return _rounded_metrics(oa.site_metrics(t.attempts())).withColumn("last_updated", _time("last_updated"))


METRICS_SQL = f"""{A}, {METRICS_CTE} SELECT site, round(mean, 6) AS avg_response_time, round(rate, 6) AS success_rate,
    ok AS success_count, bad AS failure_count, total AS total_requests, {_time_sql('last_ts')} AS last_updated FROM m"""

_MULT = """CASE WHEN rate < 0.5 THEN 2.0 WHEN rate < 0.8 THEN 1.5 ELSE 1.0 END::DOUBLE
    * CASE WHEN mean > 5.0 THEN 1.3 WHEN mean < 2.0 THEN 0.9 ELSE 1.0 END::DOUBLE"""
_DELAY = "CASE WHEN rate < 0.5 THEN 1.5 WHEN rate < 0.8 THEN 1.2 ELSE 1.0 END::DOUBLE"
PACING_COLUMNS = f"""round(greatest(5.0, least(60.0, 30.0::DOUBLE * {_MULT})), 6) AS request_timeout,
    round(greatest(10.0, least(120.0, 30.0::DOUBLE * {_MULT})), 6) AS page_load_timeout,
    greatest(1, trunc(3 * {_DELAY})::INT)::INT AS delay_min, greatest(3, trunc(8 * {_DELAY})::INT)::INT AS delay_max,
    round(least(1.0, total / 20.0), 6)::DOUBLE AS confidence, 'heuristic_adjusted' AS strategy"""


def pacing(t: Tables):
    p = oa.pacing(oa.site_metrics(t.attempts()))
    return p.select("site", F.round("request_timeout", 6).alias("request_timeout"),
                    F.round("page_load_timeout", 6).alias("page_load_timeout"), "delay_min", "delay_max",
                    F.round("confidence", 6).alias("confidence"), "strategy")


def pacing_by_url(t: Tables):
    """The same rule on finer keys: many URLs with few attempts reach the default branch."""
    by_user = t.attempts().withColumn("site", F.concat_ws("/", "url", F.floor(F.col("event_id") / 1000)))
    p = oa.pacing(oa.site_metrics(by_user))
    return p.groupBy("strategy", "delay_min", "delay_max", F.round("request_timeout", 4).alias("request_timeout")).agg(
        F.count(F.lit(1)).alias("n"))


PACING_URL_SQL = f"""WITH b AS ({ATTEMPTS}), a AS (SELECT * REPLACE (url || '/' || CAST(floor(event_id / 1000) AS BIGINT) AS site) FROM b),
    {METRICS_CTE},
    p AS (SELECT total, {PACING_COLUMNS} FROM m)
SELECT CASE WHEN total < 5 THEN 'default' ELSE strategy END AS strategy, CASE WHEN total < 5 THEN 3 ELSE delay_min END AS delay_min,
  CASE WHEN total < 5 THEN 8 ELSE delay_max END AS delay_max,
  round(CASE WHEN total < 5 THEN 30.0 ELSE request_timeout END, 4)::DOUBLE AS request_timeout, count(*) AS n FROM p GROUP BY 1, 2, 3, 4"""


def site_profiles(t: Tables):
    p = oa.site_profiles(t.attempts())
    return p.select("site", F.round("metrics.success_rate", 6).alias("success_rate"), "metrics.total_requests",
                    "thresholds.delay_min", "thresholds.strategy", _time("last_updated").alias("last_updated"))


def memory_stats(t: Tables):
    return oa.memory_stats(t.attempts())


def _products(t: Tables):
    return t("part").select(F.concat(F.lit("site"), F.col("p_partkey") % 40).alias("source"), "p_partkey", "p_name", "p_retailprice")


P_SQL = "p AS (SELECT 'site' || (p_partkey % 40) AS source, p_partkey, p_name, p_retailprice FROM part)"


def run_summary(t: Tables):
    return oa.run_summary(t.attempts(), _products(t))


def site_report(t: Tables):
    r = oa.site_report(t.attempts(), _products(t))
    return r.withColumn("block_types", _entries("block_types")).withColumn("elapsed", F.round("elapsed", 4))


REPORT_CTE = f"""{A}, {P_SQL}, s AS (SELECT site, count(*) AS total, sum(success::INT) AS ok, sum(latency_ms) / 1000 AS elapsed FROM a GROUP BY 1),
  b AS (SELECT site, string_agg(block_type || '=' || n, ',' ORDER BY block_type) AS block_types
        FROM (SELECT site, block_type, count(*) AS n FROM a GROUP BY 1, 2) x GROUP BY 1),
  q AS (SELECT source, count(*) AS n FROM p GROUP BY 1)"""
REPORT_SQL = f"""{REPORT_CTE} SELECT s.site, coalesce(q.n, 0) AS products, ok || '/' || total AS success_rate, block_types,
  round(elapsed, 4) AS elapsed FROM s JOIN b ON s.site = b.site LEFT JOIN q ON q.source = s.site"""


def report_totals(t: Tables):
    few = _products(t).withColumn("source", F.when(F.col("source").isin("site1", "site2", "site39"), F.col("source")).otherwise("elsewhere"))
    return oa.sites_with_products(oa.site_report(t.attempts(), few))


def last_levels(t: Tables):
    return oa.last_successful_level(t.attempts()).withColumn("last_success", _time("last_success"))


def recent_by_url(t: Tables):
    return oa.recent_by_url(t.attempts()).select("url", "history_rank", "event_id", "block_type")


def rolling_times(t: Tables):
    r = oa.rolling_response_time(t.attempts())
    return r.select("site", "event_id", F.round("rolling_latency_ms", 4).alias("rolling_latency_ms"))


def recent_by_site(t: Tables):
    return oa.recent_by_site(t.attempts(), 5).select("site", "recency", "event_id")


def failure_digest(t: Tables):
    return oa.failure_digest(t.attempts())


DIGEST_SQL = f"""{A}, f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE NOT success),
  g AS (SELECT *, row_number() OVER (PARTITION BY site, page_pattern ORDER BY ts DESC, event_id DESC) AS q FROM f WHERE r <= 10)
SELECT site, page_pattern, string_agg(concat('- Tier ', level, '/', render, ': ', block_type, ' (HTTP ', status_code, ', WAF: ',
       CASE WHEN waf_detected = '' THEN 'none' ELSE waf_detected END, ')'), chr(10) ORDER BY ts, event_id) AS digest
FROM g WHERE q <= 5 GROUP BY 1, 2"""


def remembered_configs(t: Tables):
    return oa.remembered_configs(t.attempts()).select("site", "cfg", _time("first_success").alias("first_success"), "rank")


def best_config(t: Tables):
    return oa.best_config(t.attempts())


FIRST_CTE = "f AS (SELECT site, cfg, min(ts) AS seen_at FROM a WHERE success GROUP BY 1, 2)"


def attempt_positions(t: Tables):
    return oa.attempt_positions(t.attempts()).select("url", "event_id", "attempt_index")


def levels_by_url(t: Tables):
    return oa.levels_by_url(t.attempts())


def first_results(t: Tables):
    return oa.first_rows(t.attempts(), 100, "ts", "event_id").select("event_id", "site")


def newest_success(t: Tables):
    return oa.failed_attempts(t.attempts()).groupBy("site").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def first_products(t: Tables):
    return oa.first_rows(_products(t), 3, "p_partkey").select("p_partkey", F.left("p_name", F.lit(50)).alias("title"))


def distinct_sites(t: Tables):
    return oa.distinct_sites(t.attempts())


def distinct_patterns(t: Tables):
    return oa.distinct_patterns(t.attempts())


def _ledger(t: Tables):
    return ot.task_ledger(t.task_events())


def task_ledger(t: Tables):
    return _ledger(t).withColumn("updated_at", _time("updated_at"))


LEDGER_CTE = f"""e AS ({TASK_EVENTS}),
  l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS r,
               sum((event = 'failure')::INT) OVER (PARTITION BY task_id) AS fails FROM e),
  led AS (SELECT task_id, url, site, page_pattern, CASE WHEN event IN ('enqueue', 'retry') THEN 'pending' WHEN event = 'dequeue' THEN 'running'
       WHEN event = 'success' THEN 'done' WHEN attempt_index < config_count THEN 'pending' ELSE 'failed' END AS state,
       CASE WHEN event = 'retry' THEN 0 WHEN event = 'failure' AND attempt_index < config_count THEN attempt_index + 1
            ELSE attempt_index END AS current_index, config_count, fails::BIGINT AS fail_count,
       {_time_sql()} AS updated_at, event IN ('failure', 'retry') AS at_front FROM l WHERE r = 1)"""


def _fine_ledger(t: Tables):
    """Finer tasks, so that some fail with few failures."""
    return ot.task_ledger(t.task_events().withColumn("task_id", F.concat_ws("-", "task_id", F.floor(F.col("event_id") / 500))))


FINE_CTE = LEDGER_CTE.replace(f"e AS ({TASK_EVENTS})",
                              f"e0 AS ({TASK_EVENTS}), e AS (SELECT * REPLACE (task_id || '-' || CAST(floor(event_id / 500) AS BIGINT) AS task_id) FROM e0)")


def retry_set(t: Tables):
    return ot.retry_set(_fine_ledger(t)).select("task_id", "fail_count", "current_index")


def task_summaries(t: Tables):
    return ot.task_summaries(_ledger(t))


def queue_sizes(t: Tables):
    return ot.queue_sizes(_fine_ledger(t))


def failed_without_retry(t: Tables):
    ledger = _fine_ledger(t)
    return ot.failed_without_retry(ledger, ot.retry_set(ledger)).select("task_id", "fail_count")


QUERIES = {
    "a01_attempt_stats": (attempt_stats, STATS_SQL),
    "a02_successful_configs": (successful_configs, f"""{A} SELECT event_id, cfg, round(cost_estimate, 9) AS cost_estimate FROM a
        WHERE success AND site = 'site2' AND page_pattern = 'search'"""),
    "a02_successful_configs_all": (successful_configs_all, f"""{A} SELECT site, page_pattern, cfg, count(*) AS n,
        round(sum(cost_estimate), 6) AS cost FROM a WHERE success GROUP BY 1, 2, 3"""),
    "a03_failed_attempts": (failed_attempts, f"{A} SELECT event_id, site, url, block_type FROM a WHERE NOT success"),
    "a04_site_metrics": (site_metrics, METRICS_SQL),
    "a05_pacing": (pacing, f"{A}, {METRICS_CTE} SELECT site, {PACING_COLUMNS} FROM m"),
    "a05_pacing_by_url": (pacing_by_url, PACING_URL_SQL),
    "a06_site_profiles": (site_profiles, f"""{A}, {METRICS_CTE} SELECT site, round(rate, 6) AS success_rate, total AS total_requests,
        greatest(1, trunc(3 * {_DELAY})::INT)::INT AS delay_min, 'heuristic_adjusted' AS strategy,
        {_time_sql('last_ts')} AS last_updated FROM m"""),
    "a07_memory_stats": (memory_stats, f"""{A} SELECT site, count(DISTINCT CASE WHEN success THEN cfg END) AS successful_strategies,
        sum((NOT success)::INT)::BIGINT AS attempt_count FROM a GROUP BY 1"""),
    "a08_run_summary": (run_summary, f"""{A} SELECT (SELECT count(*) FROM part) AS products_crawled, count(*) AS tasks_total,
        sum(success::INT)::BIGINT AS tasks_success FROM a"""),
    "a10_site_report": (site_report, REPORT_SQL),
    "a10_sites_with_products": (report_totals, f"""{A} SELECT count(DISTINCT CASE WHEN site IN (SELECT 'site' || (p_partkey % 40) FROM part
        WHERE p_partkey % 40 IN (1, 2, 39)) THEN site END) AS with_products, count(DISTINCT site) AS sites FROM a"""),
    "a12_last_levels": (last_levels, f"""{A} SELECT site, page_pattern, level, {_time_sql()} AS last_success FROM (SELECT *, row_number() OVER
        (PARTITION BY site, page_pattern ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE success) x WHERE r = 1"""),
    "a13_queue_sizes": (queue_sizes, f"""WITH {FINE_CTE} SELECT count(*) FILTER (state = 'pending') AS pending,
        count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'failed') AS failed FROM led"""),
    "w1_recent_by_url": (recent_by_url, f"""{A} SELECT url, r::INT AS history_rank, event_id, block_type FROM (SELECT *, row_number() OVER
        (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS r FROM a) x WHERE r <= 20"""),
    "w2_rolling_times": (rolling_times, f"""{A} SELECT site, event_id, round(avg(latency_ms) OVER
        (PARTITION BY site ORDER BY ts, event_id ROWS 49 PRECEDING), 4) AS rolling_latency_ms FROM a WHERE success"""),
    "w3_recent_by_site": (recent_by_site, f"""{A} SELECT site, r::INT AS recency, event_id FROM (SELECT *, row_number() OVER
        (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS r FROM a) x WHERE r <= 5"""),
    "w4_failure_digest": (failure_digest, DIGEST_SQL),
    "w5_remembered_configs": (remembered_configs, f"""{A}, {FIRST_CTE} SELECT site, cfg, {_time_sql('seen_at')} AS first_success,
        row_number() OVER (PARTITION BY site ORDER BY seen_at DESC)::INT AS rank FROM f"""),
    "w6_task_ledger": (task_ledger, f"WITH {LEDGER_CTE} SELECT * FROM led"),
    "w7_retry_set": (retry_set, f"""WITH {FINE_CTE} SELECT task_id, fail_count, 0 AS current_index FROM led
        WHERE state = 'failed' AND fail_count < 3"""),
    "w8_attempt_positions": (attempt_positions, f"""{A} SELECT url, event_id, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) - 1
        AS attempt_index FROM a"""),
    "w8_levels_by_url": (levels_by_url, f"{A} SELECT url, count(*) AS attempts, max(level) AS max_level FROM a GROUP BY 1"),
    "w9_task_summaries": (task_summaries, f"""WITH {LEDGER_CTE} SELECT task_id, url, site, page_pattern AS pattern, current_index,
        config_count AS total_strategies, fail_count FROM led"""),
    "l1_first_results": (first_results, f"{A} SELECT event_id, site FROM a ORDER BY ts, event_id LIMIT 100"),
    "l2_best_config": (best_config, f"""{A}, {FIRST_CTE} SELECT site, cfg AS best_cfg FROM (SELECT *, row_number() OVER
        (PARTITION BY site ORDER BY seen_at DESC) AS r FROM f) x WHERE r = 1"""),
    "l2_newest_failure": (newest_success, f"""{A} SELECT site, event_id FROM (SELECT *, row_number() OVER
        (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE NOT success) x WHERE r = 1"""),
    "l4_first_products": (first_products, "SELECT p_partkey, left(p_name, 50) AS title FROM part ORDER BY p_partkey LIMIT 3"),
    "x2_distinct_sites": (distinct_sites, f"{A} SELECT DISTINCT site FROM a"),
    "x2_distinct_patterns": (distinct_patterns, f"{A} SELECT DISTINCT page_pattern FROM a"),
    "x3_failed_without_retry": (failed_without_retry, f"""WITH {FINE_CTE} SELECT task_id, fail_count FROM led
        WHERE state = 'failed' AND fail_count >= 3"""),
}
