"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.session import work_folder


def _written(df: DataFrame, folder: str | None) -> DataFrame:
    path = work_folder(df.sparkSession, "components", folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pairs(a, b, links: DataFrame) -> DataFrame:
    return links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node, root: for each node of a link (a, b), the smallest node it is linked with.

    Every round first hangs all larger neighbours of a node onto the smallest one around it, then all smaller ones
    onto the smallest of these; the links left shorten by halves. Minima combine in the map tasks and links meet them in a
    join, so a node with very many links is never gathered. Each round is written below `folder` or the shared folder.
    """
    links, before = _written(_pairs("a", "b", links), folder), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
        links = _pairs("b", "m", both.filter("b > a").join(least, "a"))
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        lower = _pairs("b", "m", links.join(least, "a"))
        links = _written(lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), folder)
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if mark == before:
            break
        before = mark
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
