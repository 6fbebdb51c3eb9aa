"""Aggregates and histories over the attempt log.

Expected columns: site, page_pattern, url, level, cfg (opaque configuration key), success,
block_type, latency_ms, cost_estimate, llm_decision, ts and an id that breaks ties.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwatch.operators.timeline import positions, rolling_mean, top_rows
from shelfwatch.rules import modules as M
from shelfwatch.rules import sites as R

TS, ID = "ts", "event_id"


def percent_text(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", part / total * 100)).otherwise(F.lit("N/A"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """One row of totals with the counts by block type as a map.

    Rows collapse to one per (site, pattern, block type) first, in one scan; grouping sets over that
    small set give the counts by type and the different sites and patterns at once. The lists of
    sites and patterns themselves are `distinct_sites` and `distinct_patterns`, tables.
    """
    cells = attempts.groupBy("site", "page_pattern", "block_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("success").alias("ok"),
        F.count_if("llm_decision").alias("decided"),
        F.sum("cost_estimate").alias("cost"),
    )
    by = ("block_type", "site", "page_pattern")
    sets = cells.groupingSets([[c] for c in by], *by).agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("decided").alias("decided"), F.sum("cost").alias("cost"),
        *[(F.grouping(c) == 0).alias(f"by_{c}") for c in by],
    )
    typed = F.col("by_block_type")
    totals = sets.agg(
        *[F.coalesce(F.sum(F.when(typed, F.col(c))), F.lit(0)).alias(c) for c in ("n", "ok", "decided", "cost")],
        F.count_if(F.col("by_site") & F.col("site").isNotNull()).alias("site_count"),
        F.count_if(F.col("by_page_pattern") & F.col("page_pattern").isNotNull()).alias("pattern_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(typed, F.struct("block_type", "n"))))).alias("block_types"),
    )
    return totals.select(
        F.col("n").alias("total"), F.col("ok").alias("success"), (F.col("n") - F.col("ok")).alias("failed"),
        percent_text(F.col("ok"), F.col("n")).alias("success_rate"),
        F.col("decided").alias("llm_decisions"),
        F.format_string("$%.4f", F.col("cost").cast("double")).alias("total_cost_estimate"),
        "site_count", "pattern_count", "block_types",
    )


def distinct_sites(attempts: DataFrame) -> DataFrame:
    return attempts.select("site").distinct()


def distinct_patterns(attempts: DataFrame) -> DataFrame:
    return attempts.select("page_pattern").distinct()


def successful_configs(attempts: DataFrame, site: str | None = None, pattern: str | None = None) -> DataFrame:
    """Successful configurations in log order, for one (site, pattern) or for all of them."""
    hits = attempts.filter("success")
    if site is not None:
        hits = hits.filter((F.col("site") == site) & (F.col("page_pattern") == pattern))
    return hits.select("site", "page_pattern", TS, ID, "cfg", "cost_estimate")


def failed_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.filter(~F.col("success"))


def site_metrics(attempts: DataFrame, kept: int = M.RESPONSE_TIMES_KEPT) -> DataFrame:
    """Per site: mean response seconds of the last successes (0 if none), rate (1 if none), counts."""
    counts = attempts.groupBy("site").agg(
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.count(F.lit(1)).alias("total_requests"),
        F.max(TS).alias("last_updated"),
    )
    recent = (
        top_rows(attempts.filter("success").select("site", TS, ID, "latency_ms"), ["site"], [TS, ID], kept)
        .groupBy("site")
        .agg(F.avg(F.col("latency_ms") / 1000).alias("mean"))
    )
    return counts.join(recent, "site", "left").select(
        "site",
        F.coalesce("mean", F.lit(0.0)).alias("avg_response_time"),
        F.when(F.col("total_requests") == 0, F.lit(1.0))
        .otherwise(F.col("success_count") / F.col("total_requests")).alias("success_rate"),
        "success_count", "failure_count", "total_requests", "last_updated",
    )


def pacing(
    metrics: DataFrame, request_timeout: float = M.REQUEST_TIMEOUT, page_load_timeout: float = M.PAGE_LOAD_TIMEOUT
) -> DataFrame:
    """Timeout and delay recommendation from site metrics and the configured base timeouts."""
    rate, mean, total = F.col("success_rate"), F.col("avg_response_time"), F.col("total_requests")
    known = total >= 5
    by_rate = F.when(rate < 0.5, 2.0).when(rate < 0.8, 1.5).otherwise(1.0)
    by_time = F.when(mean > 5.0, 1.3).when(mean < 2.0, 0.9).otherwise(1.0)
    delay = F.when(rate < 0.5, 1.5).when(rate < 0.8, 1.2).otherwise(1.0)
    low, high = M.DELAY_RANGE

    def bounded(base, least, most):
        value = F.greatest(F.lit(least), F.least(F.lit(most), F.lit(base) * by_rate * by_time))
        return F.when(known, value).otherwise(F.lit(base))

    def seconds(base, least):
        value = F.greatest(F.lit(least), (F.lit(base) * delay).cast("int"))
        return F.when(known, value).otherwise(F.lit(base))

    return metrics.select(
        "*",
        bounded(request_timeout, 5.0, 60.0).alias("request_timeout"),
        bounded(page_load_timeout, 10.0, 120.0).alias("page_load_timeout"),
        seconds(low, 1).alias("delay_min"),
        seconds(high, 3).alias("delay_max"),
        F.when(known, F.least(F.lit(1.0), total / 20.0)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(known, F.lit("heuristic_adjusted")).otherwise(F.lit("default")).alias("strategy"),
    )


def site_profiles(attempts: DataFrame) -> DataFrame:
    """Metrics and pacing of every site as two structs."""
    metrics = ["avg_response_time", "success_rate", "success_count", "failure_count", "total_requests"]
    thresholds = ["request_timeout", "page_load_timeout", "delay_min", "delay_max", "confidence", "strategy"]
    return pacing(site_metrics(attempts)).select(
        "site", F.struct(*metrics).alias("metrics"), F.struct(*thresholds).alias("thresholds"), "last_updated"
    )


def memory_stats(attempts: DataFrame) -> DataFrame:
    """Per site: distinct configurations that succeeded, and failed attempts."""
    cells = attempts.groupBy("site", "cfg").agg(
        F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("bad")
    )
    return cells.groupBy("site").agg(
        F.count_if(F.col("ok") > 0).alias("successful_strategies"), F.sum("bad").alias("attempt_count")
    )


def run_summary(tasks: DataFrame, products: DataFrame) -> DataFrame:
    """Products, tasks and task successes of a run."""
    parts = products.agg(F.count(F.lit(1)).alias("products_crawled")).unionByName(
        tasks.agg(F.count(F.lit(1)).alias("tasks_total"), F.count_if("success").alias("tasks_success")),
        allowMissingColumns=True,
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def site_report(attempts: DataFrame, products: DataFrame) -> DataFrame:
    """Per site: products, success ratio as text, counts by block type, elapsed seconds."""
    by_type = attempts.groupBy("site", "block_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.sum("latency_ms").alias("ms")
    )
    per_site = by_type.groupBy("site").agg(
        F.sum("n").alias("total"), F.sum("ok").alias("ok"),
        (F.sum("ms") / 1000).alias("elapsed"),
        # At most one entry per block type, and the types are a closed list.
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("block_type", "n")))).alias("block_types"),
    )
    counted = products.groupBy(F.col("source").alias("site")).agg(F.count(F.lit(1)).alias("products"))
    return per_site.join(counted, "site", "left").select(
        "site", F.coalesce("products", F.lit(0)).alias("products"),
        F.concat_ws("/", F.col("ok").cast("string"), F.col("total").cast("string")).alias("success_rate"),
        "block_types", "elapsed",
    )


def sites_with_products(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("products") > 0).alias("with_products"), F.count(F.lit(1)).alias("sites"))


def last_successful_level(attempts: DataFrame) -> DataFrame:
    """Newest successful level by (site, pattern); a maximum, so map tasks combine first."""
    return (
        attempts.filter("success")
        .groupBy("site", "page_pattern")
        .agg(F.max_by("level", F.struct(TS, ID)).alias("level"), F.max(TS).alias("last_success"))
    )


# ---- histories -------------------------------------------------------------------------------


def recent_by_url(attempts: DataFrame, kept: int = M.ATTEMPTS_KEPT) -> DataFrame:
    """The last attempts of every URL, newest first as history_rank 1."""
    return top_rows(attempts, ["url"], [TS, ID], kept, rank="history_rank", shards=1)


def recent_by_site(attempts: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(attempts, ["site"], [TS, ID], n, rank="recency")


def rolling_response_time(attempts: DataFrame, kept: int = M.RESPONSE_TIMES_KEPT) -> DataFrame:
    """Mean latency over the site's last successes, at each success."""
    return rolling_mean(
        attempts.filter("success").select("site", TS, ID, "latency_ms"),
        ["site"], TS, ID, "latency_ms", kept, name="rolling_latency_ms",
    )


def failure_digest(attempts: DataFrame, last: int = 10, shown: int = 5) -> DataFrame:
    """Per (site, pattern): the last failures of the site that have this pattern, a line each.

    The newest `last` failures of the site are cut first, then the newest `shown` of a pattern.
    """
    line = F.format_string(
        "- Tier %d/%s: %s (HTTP %d, WAF: %s)", F.col("level"), F.col("render"), F.col("block_type"),
        F.col("status_code"), F.coalesce(F.nullif("waf_detected", F.lit("")), F.lit("none")),
    )
    newest = W.partitionBy("site", "page_pattern").orderBy(F.col(TS).desc(), F.col(ID).desc())
    entries = F.sort_array(F.collect_list(F.struct(TS, ID, line.alias("line"))))
    return (
        top_rows(failed_attempts(attempts), ["site"], [TS, ID], last)
        .withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= shown)
        .groupBy("site", "page_pattern")
        .agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("digest"))
    )


def remembered_configs(attempts: DataFrame) -> DataFrame:
    """Distinct successful configurations per site; the first success decides, newest is rank 1.

    First successes are one row per (site, cfg) after a pre-aggregated minimum.
    """
    first = (
        attempts.filter("success").groupBy("site", "cfg")
        .agg(F.min(F.struct(TS, ID)).alias("at"))
    )
    newest = W.partitionBy("site").orderBy(F.col("at").desc())
    return first.withColumn("rank", F.row_number().over(newest)).select(
        "site", "cfg", F.col("at")[TS].alias("first_success"), "rank"
    )


def best_config(attempts: DataFrame) -> DataFrame:
    """The newest remembered configuration per site, without ranking them all."""
    first = attempts.filter("success").groupBy("site", "cfg").agg(F.min(F.struct(TS, ID)).alias("at"))
    return first.groupBy("site").agg(F.max_by("cfg", "at").alias("best_cfg"))


def attempt_positions(attempts: DataFrame) -> DataFrame:
    """Attempt index of each row within its URL, from 0."""
    return positions(attempts, ["url"], TS, ID).withColumn("attempt_index", F.col("position") - 1).drop("position")


def levels_by_url(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.max("level").alias("max_level"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a stated order: a top-k, which Spark keeps per task and merges."""
    return df.orderBy(*order).limit(n)


def level_range(rows: DataFrame, start: str = "level", last: int = R.LAST_LEVEL) -> DataFrame:
    """One row per level from the start level to the last."""
    return rows.filter(F.col(start) <= last).withColumn(
        "step_level", F.explode(F.sequence(F.col(start), F.lit(last)))
    )
