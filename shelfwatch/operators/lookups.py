"""Dimension lookups, cached values with a time to live, and precedence between them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators.timeline import as_of, as_of_each
from shelfwatch.rules import modules as M
from shelfwatch.rules import sites as R
from shelfwatch.session import rule_table


def level_table(spark: SparkSession) -> DataFrame:
    return rule_table(spark, R.level_rows(), "site string, page_pattern string, level int")


def url_format_table(spark: SparkSession) -> DataFrame:
    return rule_table(
        spark, R.URL_FORMATS,
        "site string, search_url_pattern string, search_param string, page_param string, "
        "product_url_pattern string, uses_js_rendering boolean",
    )


def search_template_table(spark: SparkSession) -> DataFrame:
    """Search templates of both entry paths: variant, site, template, page suffix (NULL: by "?")."""
    rows = [("batch", s, t, None) for s, t in R.BATCH_SEARCH_TEMPLATES.items()]
    rows += [("multi", s, t, "&page=") for s, t in R.SPIDER_SEARCH_TEMPLATES.items()]
    rows += [("spider", s, t, R.SPIDER_PAGE_SUFFIXES.get(s, "&page="))
             for s, t in R.SPIDER_SEARCH_TEMPLATES.items()]
    return rule_table(spark, rows, "variant string, site string, template string, suffix string")


def registered_only(tasks: DataFrame) -> DataFrame:
    """Rows of registered sites. The list is fixed, so this is a filter and no join."""
    return tasks.filter(F.col("site").isin(R.REGISTERED_SITES))


def with_pattern_fallback(
    rows: DataFrame, dimension: DataFrame, value: str, default, fixed_size: bool = False
) -> DataFrame:
    """Value by (site, page_pattern), else the site's "unknown" row, else the default.

    A rule table has a fixed size and is broadcast; a dimension given by the caller is left to
    the planner, which broadcasts it only below its measured size limit.
    """
    hint = F.broadcast if fixed_size else (lambda df: df)
    exact = dimension.select("site", "page_pattern", F.col(value).alias("_exact"))
    unknown = dimension.filter(F.col("page_pattern") == "unknown").select(
        "site", F.col(value).alias("_unknown")
    )
    return (
        rows.join(hint(exact), ["site", "page_pattern"], "left")
        .join(hint(unknown), "site", "left")
        .withColumn(value, F.coalesce("_exact", "_unknown", default))
        .drop("_exact", "_unknown")
    )


def start_levels(rows: DataFrame) -> DataFrame:
    """Start level of each (site, page_pattern) row from the fixed level table."""
    return with_pattern_fallback(
        rows, level_table(rows.sparkSession), "level", F.lit(R.DEFAULT_LEVEL), fixed_size=True
    )


def url_formats(sites: DataFrame) -> DataFrame:
    """URL format of every site row: a known one, else the generic search address."""
    known = url_format_table(sites.sparkSession)
    generic = F.format_string("https://www.%s.com/search?q={query}", F.col("site"))
    return sites.join(F.broadcast(known), "site", "left").select(
        *sites.columns,
        F.coalesce("search_url_pattern", generic).alias("search_url_pattern"),
        F.coalesce("search_param", F.lit("q")).alias("search_param"),
        F.coalesce("page_param", F.lit("page")).alias("page_param"),
        F.coalesce("product_url_pattern", F.lit("")).alias("product_url_pattern"),
        F.coalesce("uses_js_rendering", F.lit(True)).alias("uses_js_rendering"),
    )


def cached_value(
    lookups: DataFrame, values: DataFrame, keys: list[str], value: str,
    ttl_seconds: int = M.CACHE_SECONDS, ts: str = "ts", tie: str = "event_id", name: str | None = None,
) -> DataFrame:
    """The key's newest value at each lookup, NULL once it is older than the time to live."""
    return as_of(lookups, values, keys, ts, tie, value, ttl_seconds, name)


def latest_values(values: DataFrame, keys: list[str], value: str, now, ttl_seconds: int = M.CACHE_SECONDS,
                  ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest value per key that is still fresh at `now` (a timestamp column)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp"))
    return (
        values.groupBy(*keys)
        .agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias("cached_at"))
        .filter(age < ttl_seconds * 1_000_000)
    )


def initial_levels(
    lookups: DataFrame, successes: DataFrame, computed: DataFrame, ttl_seconds: int = M.CACHE_SECONDS,
    ts: str = "ts", tie: str = "event_id",
) -> DataFrame:
    """Level at each lookup: last fresh success, else last fresh computed value, else the table."""
    keys = ["site", "page_pattern"]
    plain = lookups.drop("level")
    found = as_of_each(
        plain, {"_success_level": successes, "_computed_level": computed}, keys, ts, tie, "level", ttl_seconds
    )
    return start_levels(found).withColumn(
        "level", F.coalesce("_success_level", "_computed_level", "level")
    ).drop("_success_level", "_computed_level")


def with_best_config(tasks: DataFrame, best: DataFrame) -> DataFrame:
    """Put the site's best configuration in front of a task's list when it is not there already."""
    first = F.get("configs", F.lit(0))
    lacking = F.col("best_cfg").isNotNull() & ~first.eqNullSafe(F.col("best_cfg"))
    return tasks.join(best, "site", "left").withColumn(
        "configs", F.when(lacking, F.concat(F.array("best_cfg"), "configs")).otherwise(F.col("configs"))
    )


def invalidate(cache: DataFrame, stale: DataFrame | None, keys: list[str]) -> DataFrame:
    """Cache rows without the stale keys; with no key list given, an empty cache."""
    if stale is None:
        return cache.limit(0)
    return cache.join(stale.select(*keys).distinct(), keys, "left_anti")
