"""Verdict sharing: responses with the same status and the same text, or opening, share one verdict."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.responses import reasoned_code, reasoned_outcome, with_lowered


def shared_verdicts(responses: DataFrame, id_column: str, key_chars: int | None = None) -> DataFrame:
    """id, status_code, verdict struct. Responses that share their whole text share its verdict.

    With key_chars, the first response (by id) of each opening of that length decides for all of
    them, which gives a response another one's verdict where texts part later. Every response is
    labelled in place, which is cheaper than shuffling its text. Then the shuffle carries only
    (key, id, code); groups combine in the map tasks, and only openings whose responses disagree
    come back, so a common opening is not a hot join key unless it must be.
    """
    own = reasoned_code(F.col("status_code"), F.col("text"), F.col("lowered"))
    if key_chars is None:
        return with_lowered(responses).select(id_column, "status_code", reasoned_outcome(own).alias("verdict"))
    opening = F.left(F.coalesce("text", F.lit("")), F.lit(key_chars))
    labelled = with_lowered(responses).select(
        id_column, "status_code", F.coalesce("status_code", F.lit(-1)).alias("_status"),
        F.sha2(opening, 256).alias("_key"),
        own.alias("_own"),
    )
    deciding = (
        labelled.groupBy("_status", "_key")
        .agg(F.min_by("_own", id_column).alias("_first"), F.min("_own").alias("_lo"), F.max("_own").alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
        .select("_status", "_key", "_first")
    )
    return labelled.join(deciding, ["_status", "_key"], "left").select(
        id_column, "status_code", reasoned_outcome(F.coalesce("_first", "_own")).alias("verdict")
    )
