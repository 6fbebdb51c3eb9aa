"""Product validation and dedup."""

from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators.components import components
from shelfwatch.session import work_folder

MIN_TITLE_CHARS = 5
SETTLE_ROWS = 100_000  # rows that one task goes through in order, at most
KEYS = ("_id", "_url")


def validated(products: DataFrame) -> DataFrame:
    """Blank a price without digits on rows with a usable title; is_valid marks usable rows."""
    titled = F.length(F.coalesce("title", F.lit(""))) >= MIN_TITLE_CHARS
    blank = titled & ~F.col("price").rlike("[0-9]")
    return products.withColumn("price", F.when(blank, F.lit("")).otherwise(F.col("price"))).withColumn(
        "is_valid", titled
    )


def _with_first(rest: DataFrame) -> DataFrame:
    """_first: the row comes first of all rows that share one of its keys. Minima combine in the map tasks."""
    for key in KEYS:
        least = rest.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_place").alias(f"{key}_least"))
        rest = rest.join(least, key, "left")
    first = [F.col(k).isNull() | (F.col(f"{k}_least") == F.col("_place")) for k in KEYS]
    return rest.withColumn("_first", first[0] & first[1]).drop("_id_least", "_url_least")


def with_keys(products: DataFrame, row_key: list[str], order: list[str] | None = None, page_url: str | None = None) -> DataFrame:
    """Adds _place, the order of the rows, and the two keys _id and _url, NULL where they bind nothing."""
    by_url = F.coalesce("url", F.lit("")) != ""
    if page_url is not None:
        by_url = by_url & ~F.col("url").eqNullSafe(F.col(page_url))
    return products.withColumns({
        "_place": F.struct(*[F.col(c) for c in [*(order or ["extracted_at"]), *row_key]]),
        "_id": F.when(F.coalesce("asin", F.lit("")) != "", F.to_json(F.struct("source", "asin"))),
        "_url": F.when(by_url, F.col("url")),
    })


def without_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that share neither key (_id, _url) with a row of `known`."""
    for key in KEYS:
        rows = rows.join(known.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def _settled(rows: DataFrame, group: str) -> DataFrame:
    """The rows that stay, group by group in one pass each over its rows in order.

    A partition holds whole groups; a group's keys seen so far are all that a task keeps.
    """
    names = rows.columns

    def run(batches):
        at, seen = None, (set(), set())
        for batch in batches:
            keep = []
            for own, *keys in zip(*(batch[c].to_pylist() for c in (group, *KEYS)), strict=True):
                if own != at:
                    at, seen = own, (set(), set())
                stays = not any(k in s for k, s in zip(keys, seen, strict=True))
                if stays:
                    for k, s in zip(keys, seen, strict=True):
                        if k is not None:
                            s.add(k)
                keep.append(stays)
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(keep, pa.bool_()))

    return rows.sortWithinPartitions(group, "_place").mapInArrow(run, rows.schema)


def _components(rest: DataFrame, folder: str | None) -> DataFrame:
    """`rest` with _group, equal for rows that hang together by keys, and _size, the rows of the group."""
    node = {k: F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), F.col(k))) for k in KEYS}  # a clash only joins two groups
    rows = rest.withColumn("_a", node["_id"]).withColumn("_b", node["_url"])
    rows = rows.withColumn("_node", F.coalesce("_a", "_b"))
    roots = components(rows.filter("_a IS NOT NULL AND _b IS NOT NULL").select(F.col("_a").alias("a"), F.col("_b").alias("b")), folder)
    rows = rows.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_group", F.coalesce("root", "_node"))
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    return rows.drop("_a", "_b", "_node", "root").join(sizes, "_group")


def deduplicated(
    products: DataFrame, row_key: list[str], order: list[str] | None = None,
    page_url: str | None = None, folder: str | None = None, known: DataFrame | None = None, settle: int = SETTLE_ROWS,
) -> DataFrame:
    """What stays of the products if each is dropped when an earlier kept one has its (source, asin) or url.

    row_key names columns that identify a row, such as page and position; earlier is by extraction
    time with the row key as tie-break. An empty key binds nothing, and neither does a url that is
    the page's own address, in the column page_url. Rows that share a key with a row of `known` (as with_keys
    gives them), all of which come before, go at once.

    A round, written below `folder` or the shared folder, keeps the rows that come first by both keys, and drops
    those that share a key with them; a row that goes thus never pushes out another one. Most rows are decided in
    the first. What is left are chains of rows that wait for each other. Up to `settle` rows of them are gone through
    in order in one pass. Of more, after every third round, each group of rows that hang together is, if it has
    `settle` rows at most; only larger groups go on in rounds.
    """
    spark, columns = products.sparkSession, products.columns
    rest, kept = with_keys(products, row_key, order, page_url), []
    if known is not None:
        rest = without_known(rest, known)

    def written(df, name):
        path = work_folder(spark, name, folder)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    for n in count(1):
        decided = written(_with_first(rest), "dedup")
        first = decided.filter("_first")
        kept.append(first.drop("_first"))
        rest = without_known(decided.filter("NOT _first").drop("_first"), first)
        left = rest.limit(settle + 1).count()
        if left > settle and n % 3:
            continue
        if left > settle:
            groups = written(_components(rest, folder), "dedup-groups")
            some = groups.filter(F.col("_size") <= settle).drop("_size")
            kept.append(written(_settled(some.repartition("_group"), "_group").drop("_group"), "dedup-settled"))
            rest = groups.filter(F.col("_size") > settle).drop("_size", "_group")
            if not rest.isEmpty():
                continue
        elif left:
            one = rest.withColumn("_group", F.lit(0)).repartition(1)
            kept.append(written(_settled(one, "_group").drop("_group"), "dedup-settled"))
        return reduce(DataFrame.unionByName, kept).select(*columns)


def by_source(products: DataFrame) -> DataFrame:
    return products.groupBy("source").agg(F.count(F.lit(1)).alias("products"))
