"""Labelled example sets from the attempt log, and their scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.rules import modules as M

FALLBACK_LEVEL = 6


def _attempt_history() -> Column:
    return F.array().cast("array<string>")


def exported_examples(attempts: DataFrame, config: list[str], first: str, second: str) -> DataFrame:
    """Successful attempts as examples. config columns form the opaque configuration struct."""
    return attempts.filter("success").select(
        "site", "page_pattern", "block_type", "response_snippet",
        _attempt_history().alias("attempt_history"),
        F.struct(*config).alias("recommended_strategy"),
        F.when(F.col("attempt_index") == 0, F.lit("high")).otherwise(F.lit("medium")).alias("confidence"),
        F.format_string("Succeeded on %s/%s with %s + %s", "site", "page_pattern", first, second).alias("reasoning"),
    )


def outcome_examples(attempts: DataFrame) -> DataFrame:
    """Outcome set: successes, with defaults for keys the log may lack."""
    have = set(attempts.columns)

    def with_default(name: str, default: Column, kind: str) -> Column:
        return (F.coalesce(F.col(name), default) if name in have else default.cast(kind)).alias(name)

    return attempts.filter(F.coalesce("success", F.lit(False))).select(
        "site", "page_pattern", "block_type",
        with_default("response_snippet", F.lit(""), "string"),
        with_default("attempt_history", _attempt_history(), "array<string>"),
        with_default("recommended_strategy", F.lit("{}"), "string"),
        with_default("confidence", F.lit("medium"), "string"),
        with_default("reasoning", F.lit(""), "string"),
    )


def level_examples(attempts: DataFrame) -> DataFrame:
    """Level set: successes with an initial or a start level, read as numbers.

    A missing, zero or empty initial level gives way to the start level; unreadable text gives 6.
    """
    usable = F.col("initial_level").isNotNull() | F.col("start_level").isNotNull()
    initial = F.nullif(F.nullif("initial_level", F.lit("")), F.lit("0"))
    level = F.coalesce(initial, F.col("start_level"), F.lit(str(FALLBACK_LEVEL))).try_cast("int")
    return attempts.filter(F.coalesce("success", F.lit(False)) & usable).select(
        "site", "page_pattern",
        F.coalesce("difficulty_hint", F.lit("")).alias("difficulty_hint"),
        F.coalesce("failure_history", F.lit("")).alias("failure_history"),
        F.coalesce(level, F.lit(FALLBACK_LEVEL)).alias("start_level"),
        F.coalesce("confidence", F.lit("medium")).alias("confidence"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
    )


def config_match_score(confidence: Column, is_text: Column, predicted: dict, expected: dict) -> Column:
    """Score of a predicted configuration. The dicts give the four compared columns by name."""
    weights = {"route": 0.4, "render": 0.4, "change_ua": 0.1, "use_cookies": 0.1}
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(predicted[name].eqNullSafe(expected[name]), weight).otherwise(0.0)
    return (
        F.when(~F.coalesce(confidence.isin("high", "medium"), F.lit(False)), 0.0)
        .when(is_text, 0.5)
        .otherwise(F.least(total, F.lit(1.0)))
    )


def level_score(predicted: Column, expected: Column) -> Column:
    """1 for the same level, 0.5 for a neighbour, else 0. A missing level counts as 0."""
    gap = F.abs(F.coalesce(predicted, F.lit(0)) - F.coalesce(expected, F.lit(0)))
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)


def score_predictions(examples: DataFrame, predictions: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Join predictions to examples and score each pair; score is any column over both sides."""
    return examples.join(predictions, keys).select(*keys, score.alias("score"))


def readiness(attempts: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Per module: totals, rows since the last build, and whether and why (not) it may be built.

    states holds module, version, last_built (timestamp) and last_built_rows, at most a row each.
    """
    return readiness_of(attempts.agg(F.count(F.lit(1)).alias("total_traces")), states, now)


def readiness_of(total_row: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """As `readiness`, from one row with total_traces, which the fixed module list expands; nothing is cross-joined."""
    modules = F.array(*[
        F.struct(F.lit(n).alias("module"), F.lit(a).alias("min_traces"), F.lit(b).alias("min_new_traces"),
                 F.lit(c).alias("train_interval"))
        for n, a, b, c, _ in M.MODULES
    ])
    total, new = F.col("total_traces"), F.col("new_traces")
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_built")
    too_soon = (F.col("last_built_rows") > 0) & (idle < F.col("train_interval"))
    reason = (
        F.when(total < F.col("min_traces"), F.format_string("total_traces %d < %d", total, "min_traces"))
        .when(new < F.col("min_new_traces"), F.format_string("new_traces %d < %d", new, "min_new_traces"))
        .when(too_soon, F.lit("too soon since last training"))
        .otherwise(F.lit("ready"))
    )
    return (
        total_row.select("total_traces", F.inline(modules))
        .join(states, "module", "left")
        .withColumn("version", F.coalesce("version", F.lit(0)))
        .withColumn("last_built_rows", F.coalesce("last_built_rows", F.lit(0)))
        .withColumn("new_traces", total - F.col("last_built_rows"))
        .withColumn("reason", reason)
        .select(
            "module", "version", "last_built", "total_traces", "new_traces",
            ((new >= F.col("min_new_traces")) & (total >= F.col("min_traces"))).alias("enough"),
            (F.col("reason") == "ready").alias("ready"), "reason",
        )
    )


def version_states(builds: DataFrame) -> DataFrame:
    """State of each module from its build log: version count, newest build and its row count."""
    return builds.groupBy("module").agg(
        F.count(F.lit(1)).cast("int").alias("version"),
        F.max("built_at").alias("last_built"),
        F.max_by("rows", "built_at").alias("last_built_rows"),
    )
