"""Bounded samples of labelled documents, for the two scoring operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import text_of

TRAIN_ROWS = 20_000  # labelled rows a model is fitted on, at most


def held_out() -> Column:
    """Every third document by the checksum of its id: never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, label, turn (0 to 99, for splits): the `rows` labelled documents first by id hash.

    One row an id: of an id labelled twice the larger label, of one with several texts the text with the smallest
    hash, so that no document outweighs the others. The ids are few, by `rows`, so they are broadcast; only their texts are shuffled.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .select(F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label"))
    )
    own = docs.select("doc_id", text_of().alias("text"))
    texts = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return texts.select("first.text", "label", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(100)).cast("int").alias("turn"))
