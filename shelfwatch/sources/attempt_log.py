"""Attempt log as JSON lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.responses import sample
from shelfwatch.schemas import ATTEMPT_LINE_DDL

CORRUPT = "_corrupt_line"
# Crawlers leave .jsonl files; Spark's own JSON writer names its files .json.
LOG_FILES = "*.{jsonl,json}"


def backfilled(lines: DataFrame) -> DataFrame:
    """Missing keys filled with their typed defaults; the timestamp text parsed beside it."""
    numbers = {"status_code": 0, "full_html_size": 0, "strategy_tier": 1, "ip_rotation_count": 0}
    texts = ["site", "page_pattern", "url", "block_type", "response_snippet", "waf_detected", "human_friendly_summary"]
    out = lines
    for name, value in numbers.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    for name in texts:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    return (
        out.withColumn("response_headers", F.coalesce("response_headers", empty))
        .withColumn("llm_decision", F.coalesce("llm_decision", F.lit(False)))
        .withColumn("event_time", F.try_to_timestamp("timestamp"))
    )


def read_attempts(spark: SparkSession, path: str, strict: bool = False, pattern: str = LOG_FILES) -> DataFrame:
    """All files of a folder that match the pattern. Blank lines are skipped.

    strict raises at the first bad line. Otherwise bad lines come back with their text in
    _corrupt_line, so none is lost unseen.
    """
    reader = spark.read.option("pathGlobFilter", pattern)
    if strict:
        lines = reader.schema(ATTEMPT_LINE_DDL).option("mode", "FAILFAST").json(path)
    else:
        lines = (
            reader.schema(f"{ATTEMPT_LINE_DDL}, {CORRUPT} string")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
        )
    return backfilled(lines)


def with_file_place(lines: DataFrame) -> DataFrame:
    """Rows with _file, _block and _line, whose order is that of the lines. For rows just read.

    A file split is read by one task from its start, so within it the running id follows the lines.
    """
    return lines.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                              "_line": F.monotonically_increasing_id()})


def in_file_order(lines: DataFrame) -> DataFrame:
    """Rows ordered by the name of their file, then by place in it, where a job needs that order."""
    return with_file_place(lines).orderBy("_file", "_block", "_line").drop("_file", "_block", "_line")


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append rows to the log folder as JSON lines, one file per task."""
    attempts.write.mode("append").option("ignoreNullFields", "false").json(path)


def recorded(
    responses: DataFrame, verdict: Column, success: Column, latency_ms: Column, cost: Column
) -> DataFrame:
    """New attempt rows from fetched responses: 12-character id, UTC time, snippet cut to 2000.

    Expects url, site, page_pattern, text, status_code, level, attempt_index and headers.
    """
    return responses.select(
        F.substr(F.expr("uuid()"), F.lit(1), F.lit(12)).alias("trace_id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "site", "page_pattern", "url", verdict.alias("block_type"),
        sample(F.coalesce("text", F.lit("")), "snippet").alias("response_snippet"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("response_headers"),
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("full_html_size"),
        F.coalesce("level", F.lit(1)).alias("strategy_tier"),
        success.alias("success"), latency_ms.alias("latency_ms"), cost.alias("cost_estimate"),
        "attempt_index", F.lit(False).alias("llm_decision"), F.lit(0).alias("ip_rotation_count"),
        F.lit("").alias("waf_detected"), F.lit("").alias("human_friendly_summary"),
    )
