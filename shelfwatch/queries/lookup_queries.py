"""Lookups with fallbacks and cached values."""

from pyspark.sql import functions as F

from shelfwatch.operators import attempts as oa
from shelfwatch.operators import lookups as ol
from shelfwatch.queries.tables import ATTEMPTS, SHOP_URLS, Tables
from shelfwatch.queries.url_queries import PATTERN_SQL, _values
from shelfwatch.functions import urls as fu
from shelfwatch.rules import sites as R

A = f"WITH a AS ({ATTEMPTS})"
LEVELS_CTE = f"lv(site, page_pattern, level) AS ({_values(R.level_rows())})"


def _shop_tasks(t: Tables):
    return t.shop_urls().select("page_id", "site", "shop_url").withColumn(
        "page_pattern", fu.page_pattern(F.col("site"), F.col("shop_url")))


def start_levels(t: Tables):
    return ol.start_levels(_shop_tasks(t)).select("page_id", "site", "page_pattern", "level")


def config_lists(t: Tables):
    """Configuration lists per (site, pattern), with a row for "unknown" on some sites only."""
    rows, pattern = t.attempts(), F.col("page_pattern")
    listed = F.when((pattern != "review") & ((pattern != "unknown") | (F.col("level") > 6)), F.col("cfg"))
    lists = rows.groupBy("site", "page_pattern").agg(F.concat(F.lit("max "), F.max(listed)).alias("configs"))
    tasks = rows.select("event_id", F.concat(F.col("site"), F.when(F.col("event_id") % 9 == 0, F.lit("x")).otherwise(F.lit(""))).alias("site"),
                        "page_pattern")
    return ol.with_pattern_fallback(tasks, lists, "configs", F.lit("one default")).select("event_id", "configs")


CONFIG_SQL = f"""{A}, l AS (SELECT site, page_pattern,
    'max ' || max(CASE WHEN page_pattern <> 'review' AND (page_pattern <> 'unknown' OR level > 6) THEN cfg END) AS configs FROM a GROUP BY 1, 2),
  k AS (SELECT event_id, site || CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '' END AS site, page_pattern FROM a)
SELECT event_id, coalesce(e.configs, u.configs, 'one default') AS configs FROM k
LEFT JOIN l e ON e.site = k.site AND e.page_pattern = k.page_pattern
LEFT JOIN l u ON u.site = k.site AND u.page_pattern = 'unknown'"""


def level_ranges(t: Tables):
    rows = ol.start_levels(_shop_tasks(t))
    return oa.level_range(rows).groupBy("site", "page_pattern", "step_level").agg(F.count(F.lit(1)).alias("n"))


def cached_levels(t: Tables):
    """Last successful level at each attempt of the same (site, pattern), 6 hours to live."""
    a = t.attempts()
    wins = a.filter("success").select("site", "page_pattern", "ts", "event_id", "level")
    looked = a.select("site", "page_pattern", "ts", "event_id")
    return ol.cached_value(looked, wins, ["site", "page_pattern"], "level", 21600).select("event_id", "level")


CACHED_SQL = f"""{A}, w AS (SELECT event_id, site, page_pattern, ts,
    last_value(CASE WHEN success THEN level END IGNORE NULLS) OVER p AS level,
    last_value(CASE WHEN success THEN ts END IGNORE NULLS) OVER p AS seen_at FROM a
    WINDOW p AS (PARTITION BY site, page_pattern ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def latest_levels(t: Tables):
    wins = t.attempts().filter("success")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return ol.latest_values(wins, ["site", "page_pattern"], "level", now).select("site", "page_pattern", "level")


def initial_levels(t: Tables):
    a = t.attempts()
    columns = ["site", "page_pattern", "ts", "event_id", "level"]
    wins = a.filter("success").select(*columns)
    computed = a.filter("llm_decision").select(*columns)
    looked = a.select("site", "page_pattern", "ts", "event_id")
    return ol.initial_levels(looked, wins, computed, 14400).select("event_id", "level")


INITIAL_SQL = f"""{A}, w AS (SELECT event_id, ts,
    last_value(CASE WHEN success THEN level END IGNORE NULLS) OVER p AS level,
    last_value(CASE WHEN success THEN ts END IGNORE NULLS) OVER p AS seen_at,
    last_value(CASE WHEN llm_decision THEN level END IGNORE NULLS) OVER p AS level2,
    last_value(CASE WHEN llm_decision THEN ts END IGNORE NULLS) OVER p AS seen_at2 FROM a
    WINDOW p AS (PARTITION BY site, page_pattern ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN ts - seen_at < INTERVAL 4 HOUR THEN level WHEN ts - seen_at2 < INTERVAL 4 HOUR THEN level2 ELSE 1 END AS level FROM w"""


def best_first(t: Tables):
    a = t.attempts()
    tasks = a.select("event_id", "site", F.transform(F.sequence("level", F.lit(8)), lambda x: F.concat(F.lit("c"), x)).alias("configs"))
    best = oa.best_config(a.withColumn("success", F.col("success") & (F.col("site") != "site5")))  # one site without a success
    return ol.with_best_config(tasks, best).select("event_id", F.array_join("configs", ",").alias("configs"))


BEST_SQL = f"""{A}, f AS (SELECT site, cfg, min(ts) AS seen_at FROM a WHERE success AND site <> 'site5' GROUP BY 1, 2),
  b AS (SELECT site, cfg FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seen_at DESC) AS r FROM f) x WHERE r = 1),
  k AS (SELECT event_id, site, level, array_to_string(['c' || x for x in range(level, 9)], ',') AS configs FROM a)
SELECT event_id, CASE WHEN b.cfg IS NOT NULL AND b.cfg <> 'c' || level THEN b.cfg || ',' || configs ELSE configs END AS configs
FROM k LEFT JOIN b ON b.site = k.site"""


def invalidated(t: Tables):
    cache = t.attempts().groupBy("site").agg(F.max("event_id").alias("newest"))
    stale = t.attempts().filter("site LIKE 'site1%' AND NOT success").select("site")
    return ol.invalidate(cache, stale, ["site"])


QUERIES = {
    "j1_start_levels": (start_levels, f"""WITH u AS ({SHOP_URLS}), p AS (SELECT page_id, site, {PATTERN_SQL} AS page_pattern FROM u), {LEVELS_CTE}
        SELECT p.page_id, p.site, p.page_pattern, coalesce(lv.level, 1)::INT AS level FROM p
        LEFT JOIN lv ON lv.site = p.site AND lv.page_pattern = p.page_pattern"""),
    "j2_config_lists": (config_lists, CONFIG_SQL),
    "j3_level_ranges": (level_ranges, f"""WITH u AS ({SHOP_URLS}), p AS (SELECT page_id, site, {PATTERN_SQL} AS page_pattern FROM u), {LEVELS_CTE},
        s AS (SELECT p.site, p.page_pattern, unnest(range(coalesce(lv.level, 1)::INT, 9)) AS step_level FROM p
              LEFT JOIN lv ON lv.site = p.site AND lv.page_pattern = p.page_pattern)
        SELECT site, page_pattern, step_level::INT AS step_level, count(*) AS n FROM s GROUP BY 1, 2, 3"""),
    "j4_cached_levels": (cached_levels, CACHED_SQL + """ SELECT event_id, CASE WHEN ts - seen_at < INTERVAL 6 HOUR THEN level END AS level FROM w"""),
    "j4_latest_levels": (latest_levels, f"""{A} SELECT site, page_pattern, level FROM (SELECT *, row_number() OVER
        (PARTITION BY site, page_pattern ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE success) x
        WHERE r = 1 AND TIMESTAMP '2024-01-31 00:00:00' - ts < INTERVAL 24 HOUR"""),
    "j5_initial_levels": (initial_levels, INITIAL_SQL),
    "j6_best_config_first": (best_first, BEST_SQL),
    "j7_invalidated_cache": (invalidated, f"""{A} SELECT site, max(event_id) AS newest FROM a GROUP BY 1
        HAVING max(CASE WHEN site LIKE 'site1%' AND NOT success THEN 1 ELSE 0 END) = 0"""),
}
