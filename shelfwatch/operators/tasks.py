"""Task ledger: the state of every crawl task, derived from its event log.

Events carry task_id, event (enqueue, dequeue, success, failure, retry), ts and an id, plus
url, site, page_pattern, attempt_index (position in the configuration list when the event
happened) and config_count (length of that list). Tasks are not dispatched here.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRY_LIMIT = 3


def task_ledger(events: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """One row per task: state, failure count and position.

    The newest event decides the state. A failure puts the task back to pending while
    configurations are left, else it is failed. Maxima and counts combine before the shuffle, so a
    task with very many events costs no more than its map tasks.
    """
    last = F.max_by(
        F.struct("event", "attempt_index", "config_count", "url", "site", "page_pattern"), F.struct(ts, tie)
    )
    state = (
        F.when(F.col("last.event").isin("enqueue", "retry"), F.lit("pending"))
        .when(F.col("last.event") == "dequeue", F.lit("running"))
        .when(F.col("last.event") == "success", F.lit("done"))
        .when(F.col("last.attempt_index") < F.col("last.config_count"), F.lit("pending"))
        .otherwise(F.lit("failed"))
    )
    advanced = F.col("last.event") == "failure"
    return (
        events.groupBy("task_id")
        .agg(last.alias("last"), F.count_if(F.col("event") == "failure").alias("fail_count"),
             F.max(ts).alias("updated_at"))
        .select(
            "task_id", "last.url", "last.site", "last.page_pattern", state.alias("state"),
            F.when(F.col("last.event") == "retry", F.lit(0))
            .when(advanced & (F.col("last.attempt_index") < F.col("last.config_count")),
                  F.col("last.attempt_index") + 1)
            .otherwise(F.col("last.attempt_index")).alias("current_index"),
            F.col("last.config_count").alias("config_count"), "fail_count", "updated_at",
            # Re-queued tasks go to the front, newest first; new ones wait in order of arrival.
            F.col("last.event").isin("failure", "retry").alias("at_front"),
        )
    )


def retry_set(ledger: DataFrame, limit: int = RETRY_LIMIT) -> DataFrame:
    """Failed tasks that may run again, position reset."""
    return ledger.filter((F.col("state") == "failed") & (F.col("fail_count") < limit)).withColumn(
        "current_index", F.lit(0)
    )


def failed_without_retry(ledger: DataFrame, retried: DataFrame) -> DataFrame:
    return ledger.filter(F.col("state") == "failed").join(retried.select("task_id"), "task_id", "left_anti")


def task_summaries(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "task_id", "url", "site", F.col("page_pattern").alias("pattern"), "current_index",
        F.col("config_count").alias("total_strategies"), "fail_count",
    )


def queue_sizes(ledger: DataFrame) -> DataFrame:
    return ledger.agg(*[
        F.count_if(F.col("state") == s).alias(s) for s in ("pending", "running", "failed")
    ])
