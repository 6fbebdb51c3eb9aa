"""Helpers shared by the corpus operators.

Every operator reads only the columns it names, so further columns of any name do no harm. A NULL text
counts as empty. Two rows with the same doc_id and the same text are one document with one decision,
which holds for both rows; rows that share a doc_id but not a text are documents of their own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.session import work_folder

BROADCAST_ROWS = 200_000


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key() -> Column:
    """Together with doc_id this names a document."""
    return F.xxhash64(text_of())


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if it has at most `rows` rows, else as it is (a shuffled join).

    For narrow rows only; counts the frame, so pass one that is cheap to read.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores before it until no frame has such a column."""
    while any(name.lower() == c.lower() for df in frames for c in df.columns):
        name = f"_{name}"
    return name


def whole_rows(docs: DataFrame) -> DataFrame:
    """_doc, each row whole, beside its _id (doc_id as a long) and _key (text_key): no column of `docs` can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))


def words_of(text: Column, not_word: str) -> Column:
    """The words between runs of `not_word`, without empty ones."""
    return F.array_remove(F.split(text, not_word), "")


def steps(count: Column) -> Column:
    """0 .. count - 1, empty for none."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
