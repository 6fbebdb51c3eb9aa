"""Example sets and their scores."""

from pyspark.sql import functions as F

from shelfwatch.operators import examples as ox
from shelfwatch.plans import jobs
from shelfwatch.plans.example_builds import BUILDERS, ExampleBuilds
from shelfwatch.queries.tables import ATTEMPTS, Tables
from shelfwatch.rules import modules as M
from shelfwatch.session import work_folder
from shelfwatch.sources import attempt_log

A = f"WITH a AS ({ATTEMPTS})"
CONFIG = ["route", "render", "change_ua", "use_cookies", "use_human_scroll"]


def exported(t: Tables):
    x = ox.exported_examples(t.attempts(), CONFIG, "route", "render")
    return x.select("site", "page_pattern", "block_type", "response_snippet", F.size("attempt_history").alias("history"),
                    "recommended_strategy.*", "confidence", "reasoning")


EXPORT_SQL = f"""{A} SELECT site, page_pattern, block_type, response_snippet, 0 AS history, route, render, change_ua, use_cookies, use_human_scroll,
  CASE WHEN attempt_index = 0 THEN 'high' ELSE 'medium' END AS confidence,
  concat('Succeeded on ', site, '/', page_pattern, ' with ', route, ' + ', render) AS reasoning FROM a WHERE success"""


def outcomes(t: Tables):
    e = F.col("event_id")
    rows = t.attempts().withColumn("success", F.when(e % 19 > 0, F.col("success"))).withColumn(
        "response_snippet", F.when(e % 3 > 0, F.col("response_snippet"))).withColumn(
        "confidence", F.when(e % 4 == 0, F.lit("high")))
    x = ox.outcome_examples(rows)
    return x.groupBy("site", "block_type", "response_snippet", "confidence", "reasoning", "recommended_strategy").agg(
        F.count(F.lit(1)).alias("n"))


OUTCOME_SQL = f"""{A} SELECT site, block_type, CASE WHEN event_id % 3 > 0 THEN response_snippet ELSE '' END AS response_snippet,
  CASE WHEN event_id % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence, '' AS reasoning, '{{}}' AS recommended_strategy, count(*) AS n
FROM a WHERE success AND event_id % 19 > 0 GROUP BY 1, 2, 3, 4"""


def levels(t: Tables):
    e = F.col("event_id")
    none = F.lit(None).cast("string")
    rows = t.attempts().select(
        "event_id", "site", "page_pattern", "success",
        F.when(e % 5 == 0, F.lit("0")).when(e % 5 == 1, F.lit("seven")).when(e % 5 == 2, F.col("level").cast("string")).alias("initial_level"),
        F.when(e % 3 > 0, (F.col("level") + 1).cast("string")).alias("start_level"),
        none.alias("difficulty_hint"), none.alias("failure_history"), none.alias("confidence"), none.alias("reasoning"))
    return ox.level_examples(rows).groupBy("site", "page_pattern", "start_level", "confidence").agg(F.count(F.lit(1)).alias("n"))


LEVELS_SQL = f"""{A}, r AS (SELECT site, page_pattern, CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN 'seven' WHEN 2 THEN level::VARCHAR END AS i,
      CASE WHEN event_id % 3 > 0 THEN (level + 1)::VARCHAR END AS s FROM a WHERE success)
SELECT site, page_pattern, coalesce(try_cast(coalesce(CASE WHEN i NOT IN ('0', '') THEN i END, s, '6') AS INT), 6)::INT AS start_level,
  'medium' AS confidence, count(*) AS n FROM r WHERE i IS NOT NULL OR s IS NOT NULL GROUP BY 1, 2, 3"""


def _pairs(t: Tables):
    """Predictions for every attempt: the configuration the log would name three steps on."""
    a = t.attempts()
    examples = a.select("event_id", "route", "render", "change_ua", "use_cookies", "level")
    e = F.col("event_id")
    predictions = a.select(
        "event_id", F.concat(F.lit("route"), (e % 2)).alias("p_route"), F.col("render").alias("p_render"),
        (e % 3 == 0).alias("p_change_ua"), F.when(e % 4 > 0, e % 5 == 0).alias("p_use_cookies"),
        F.when(e % 7 == 0, F.lit("low")).otherwise(F.lit("high")).alias("confidence"), (e % 11 == 0).alias("is_text"),
        F.when(e % 9 > 0, (F.col("level") + e % 3 - 1).cast("int")).alias("p_level"))
    return examples, predictions


def config_scores(t: Tables):
    names = ["route", "render", "change_ua", "use_cookies"]
    score = ox.config_match_score(
        F.col("confidence"), F.col("is_text"), {n: F.col(f"p_{n}") for n in names}, {n: F.col(n) for n in names})
    scored = ox.score_predictions(*_pairs(t), ["event_id"], score)
    return scored.select("event_id", F.round("score", 4).alias("score"))


CONFIG_SCORE_SQL = f"""{A} SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 11 = 0 THEN 0.5 ELSE
  CASE WHEN 'route' || (event_id % 2) = route THEN 0.4 ELSE 0 END + 0.4 + CASE WHEN change_ua = (event_id % 3 = 0) THEN 0.1 ELSE 0 END
  + CASE WHEN event_id % 4 > 0 THEN 0.1 ELSE 0 END END::DOUBLE, 4) AS score FROM a"""


def level_scores(t: Tables):
    return ox.score_predictions(*_pairs(t), ["event_id"], ox.level_score(F.col("p_level"), F.col("level")))


LEVEL_SCORE_SQL = f"""{A}, p AS (SELECT event_id, level, CASE WHEN event_id % 9 > 0 THEN level + event_id % 3 - 1 ELSE 0 END AS guess FROM a)
SELECT event_id, CASE abs(guess - level) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM p"""


def readiness(t: Tables):
    """Module states come from a build log kept in the events: some modules were built before."""
    builds = t.attempts().filter("success").select(
        F.when(F.col("event_id") % 3 == 0, F.lit("strategy_selector")).when(F.col("event_id") % 12 == 1, F.lit("block_detector"))
        .otherwise(F.lit("initial_tier_selector")).alias("module"),
        F.col("ts").cast("timestamp").alias("built_at"),
        F.col("event_id").alias("rows"))
    states = ox.version_states(builds)
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return ox.readiness(t.attempts(), states, now).select("module", "version", "total_traces", "new_traces", "enough", "ready", "reason")


_MODULE_VALUES = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c, _ in M.MODULES)
READINESS_SQL = f"""{A}, b AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'strategy_selector' WHEN event_id % 12 = 1 THEN 'block_detector' ELSE 'initial_tier_selector' END AS module,
    ts, event_id AS rows FROM a WHERE success),
  s AS (SELECT module, count(*)::INT AS version, max(ts) AS last_built, max_by(rows, ts) AS last_rows FROM b GROUP BY 1),
  m(module, least, least_new, gap) AS (VALUES {_MODULE_VALUES}), n AS (SELECT count(*) AS total FROM a),
  j AS (SELECT m.module, coalesce(version, 0) AS version, total, total - coalesce(last_rows, 0) AS fresh, least, least_new, gap, coalesce(last_rows, 0) AS last_rows,
        epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_built) AS idle FROM m LEFT JOIN s ON s.module = m.module, n),
  r AS (SELECT *, CASE WHEN total < least THEN concat('total_traces ', total, ' < ', least) WHEN fresh < least_new THEN concat('new_traces ', fresh, ' < ', least_new)
        WHEN last_rows > 0 AND floor(idle) < gap THEN 'too soon since last training' ELSE 'ready' END AS reason FROM j)
SELECT module, version, total AS total_traces, fresh AS new_traces, fresh >= least_new AND total >= least AS enough, reason = 'ready' AS ready, reason FROM r"""


def example_sets(t: Tables):
    """The sets that a first build writes, with the readiness report of their modules."""
    folder, none = work_folder(t.spark, "examples"), F.lit(None).cast("string")
    rows = t.attempts().withColumns({
        "initial_level": F.col("level").cast("string"), **{c: none for c in
        ("start_level", "difficulty_hint", "failure_history", "confidence", "reasoning")}})
    states = t.spark.createDataFrame([], "module string, version int, last_built timestamp, last_built_rows long")
    report = jobs.build_example_sets(t.spark, rows, states, F.to_timestamp(F.lit("2024-01-31 00:00:00")), folder)
    written = t.spark.read.option("mergeSchema", "true").parquet(folder).groupBy("module").agg(F.count(F.lit(1)).alias("examples"))
    return report.join(written, "module", "left").select("module", "total_traces", "ready", F.coalesce("examples", F.lit(0)).alias("examples"))


EXAMPLE_SETS_SQL = f"""{A}, m(module, least, least_new, gap) AS (VALUES {_MODULE_VALUES}), n AS (SELECT count(*) AS total, sum(success::INT)::BIGINT AS good FROM a)
SELECT module, total AS total_traces, total >= least AND total >= least_new AS ready,
  CASE WHEN total >= least AND total >= least_new AND module IN ('strategy_selector', 'initial_tier_selector') THEN good ELSE 0 END AS examples FROM m, n"""


# Landings of the log and the minute of the build after each: the third build comes too soon and leaves its files to the next.
LANDING = "CASE WHEN event_id % 10 < 5 THEN 1 WHEN event_id % 10 < 7 THEN 2 WHEN event_id % 10 < 8 THEN 3 ELSE 4 END"
BUILD_MINUTES = [0, 300, 310, 600]


def growing_sets(t: Tables):
    """Four builds over a log that grows between them: the examples by version, from each version's own files."""
    folder = work_folder(t.spark, "a11")
    rows = t.attempts().select(
        F.expr(LANDING).alias("landing"), F.col("event_id").cast("string").alias("trace_id"), "site", "page_pattern", "block_type", "success", "latency_ms",
        F.when(F.col("event_id") % 3 > 0, F.col("level").cast("string")).alias("initial_level"))
    builds = ExampleBuilds(t.spark, f"{folder}/sets", f"{folder}/log")
    for n, minute in enumerate(BUILD_MINUTES, start=1):
        attempt_log.append_attempts(rows.filter(F.col("landing") == n).drop("landing"), f"{folder}/log")
        builds.build(F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute)))
    versions = builds.versions().select("module", "version", F.coalesce("parent", F.lit(0)).alias("parent"))
    out = []
    for module in BUILDERS:
        own = builds.examples(module).groupBy("version", "site").agg(F.count(F.lit(1)).alias("n"))
        out.append(own.withColumn("module", F.lit(module)))
    return out[0].unionByName(out[1]).join(versions, ["module", "version"])


GROWING_SQL = f"""{A}, v AS (SELECT *, least({LANDING}, 3) AS version FROM a WHERE success),
  m AS (SELECT 'strategy_selector' AS module, version, site FROM v UNION ALL SELECT 'initial_tier_selector', version, site FROM v WHERE event_id % 3 > 0)
SELECT module, version, site, count(*) AS n, version - 1 AS parent FROM m GROUP BY ALL"""


QUERIES = {
    "example_sets": (example_sets, EXAMPLE_SETS_SQL),
    "m1_s10_exported_examples": (exported, EXPORT_SQL),
    "m2_outcome_examples": (outcomes, OUTCOME_SQL),
    "m3_level_examples": (levels, LEVELS_SQL),
    "m4_f3_config_scores": (config_scores, CONFIG_SCORE_SQL),
    "m5_level_scores": (level_scores, LEVEL_SCORE_SQL),
    "a11_readiness": (readiness, READINESS_SQL),
    "a11_growing_sets": (growing_sets, GROWING_SQL),
}
