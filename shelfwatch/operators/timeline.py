"""Ordered operators per key that hold when one key owns a large share of all rows.

A plain window over a key sends the whole key to one task. Here all rows are dealt into ranges of about
equal row count by (keys, ts, tie), whatever their times, and written with the number of their range. Each
(key, range) is windowed on its own. A key that crosses range edges carries a small summary over each edge;
as ranges follow each other in order, at most one key enters a range from an earlier one, so there are no
more summaries than ranges. Results equal the plain window exactly.

(ts, tie) must order a key's rows. A missing key reads as "" or 0, as in the table schemas, so the
joins on keys lose no row; a missing time comes first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwatch.session import work_folder

RANGE = "_range"
RANGES_PER_PARTITION = 2  # ranges for each shuffle partition, so that tasks even out


def in_ranges(
    df: DataFrame, keys: list[str], ts: str, tie: str, ranges: int | None = None, folder: str | None = None
) -> DataFrame:
    """Fill missing keys and add the number of the row's range.

    Range bounds are sampled when rows are dealt, so the dealt rows are written below `folder` or the shared
    folder: all later reads see the same ranges, and every input is computed here alone.
    """
    spark, types = df.sparkSession, dict(df.dtypes)
    for key in keys:
        df = df.withColumn(key, F.coalesce(F.col(key), F.lit("" if types[key] == "string" else 0).cast(types[key])))
    count = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *keys, ts, tie).withColumn(RANGE, F.spark_partition_id())
    path = work_folder(spark, "timeline", folder)
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _carried_in(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Of one row per (key, range), those of keys entering from an earlier range. At most one a range: broadcast."""
    earlier = F.row_number().over(W.partitionBy(*keys).orderBy(RANGE))
    return F.broadcast(summaries.withColumn("_nth", earlier).filter("_nth > 1").drop("_nth"))


def _order(columns: list[str], newest: bool) -> list[Column]:
    return [F.col(c).desc() if newest else F.col(c).asc() for c in columns]


def top_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int, newest: bool = True,
    rank: str | None = None, shards: int = 32,
) -> DataFrame:
    """The first n rows per key, by order.

    Two limits: per (key, shard), then per key. Both are rank filters, so map tasks already drop
    what cannot qualify, and the last stage sees at most n * shards rows of a key. One shard is
    enough where the keys themselves are known to be small.
    """
    ordering = _order(order, newest)
    rn = rank or "_rank"
    if shards > 1:
        shard = F.pmod(F.xxhash64(*order), F.lit(shards))
        df = (
            df.withColumn("_shard", shard)
            .withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_shard").orderBy(*ordering)))
            .filter(F.col("_r") <= n)
            .drop("_r", "_shard")
        )
    return (
        df.withColumn(rn, F.row_number().over(W.partitionBy(*keys).orderBy(*ordering)))
        .filter(F.col(rn) <= n)
        .drop(*([] if rank else [rn]))
    )


def positions(
    df: DataFrame, keys: list[str], ts: str, tie: str, name: str = "position",
    ranges: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Row number per key in time order, starting at 1."""
    rows = in_ranges(df, keys, ts, tie, ranges, folder)
    earlier = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier)).drop("_n")
    )
    within = W.partitionBy(*keys, RANGE).orderBy(ts, tie)
    return (
        rows.withColumn(name, F.row_number().over(within))
        .join(_carried_in(offsets, keys), [*keys, RANGE], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def rolling_mean(
    df: DataFrame, keys: list[str], ts: str, tie: str, value: str, n: int,
    name: str = "rolling_mean", ranges: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Mean of value over the last n rows of the key, the current row included.

    The summary of a range is its last n - 1 rows; what a key carries into a range is the last n - 1 rows of
    all earlier summaries, found in the n - 1 ranges before it since none of them is without the key. Only
    keys in several ranges have summaries, so a sparse key adds no rows.
    """
    rows = in_ranges(df, keys, ts, tie, ranges, folder)
    crossing = rows.groupBy(*keys).agg(F.min(RANGE).alias("_a"), F.max(RANGE).alias("_b")).filter("_a < _b").select(*keys)
    entry = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    ends = rows.select(*keys, RANGE, ts, tie, value).join(F.broadcast(crossing), keys, "left_semi")
    tails = (
        top_rows(ends, [*keys, RANGE], [ts, tie], n - 1, shards=1)
        .groupBy(*keys, RANGE)
        .agg(F.sort_array(F.collect_list(entry)).alias("_tail"))
    )
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(-(n - 1), -1)
    carried = (
        tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(before)))
        .select(*keys, RANGE, F.inline(F.reverse(F.slice(F.reverse("_all"), 1, n - 1))))
        .select(*keys, RANGE, F.col("ts").alias(ts), F.col("tie").alias(tie),
                F.col("value").alias(value), F.lit(True).alias("_carried"))
    )
    frame = W.partitionBy(*keys, RANGE).orderBy(ts, tie).rowsBetween(-(n - 1), 0)
    return (
        rows.withColumn("_carried", F.lit(False))
        .unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.avg(value).over(frame))
        .filter(~F.col("_carried"))
        .select(*df.columns, name)
    )


def as_of(
    lookups: DataFrame, values: DataFrame, keys: list[str], ts: str, tie: str, value: str,
    ttl_seconds: int | None = None, name: str | None = None, ranges: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Attach to each lookup the key's newest earlier value, if younger than the time to live."""
    return as_of_each(lookups, {name or value: values}, keys, ts, tie, value, ttl_seconds, ranges, folder)


def as_of_each(
    lookups: DataFrame, sources: dict[str, DataFrame], keys: list[str], ts: str, tie: str, value: str,
    ttl_seconds: int | None = None, ranges: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Attach to each lookup the newest earlier value of every source, in one pass over all rows.

    "Earlier" is by (ts, tie); a value at the very same position is not seen. The summary of a
    range is its newest value, so what a key carries is one running maximum over its ranges.
    """
    places = {name: f"_new_{i}" for i, name in enumerate(sources)}
    newest = F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    union = lookups.withColumn("_is_value", F.lit(0))
    for name, values in sources.items():
        given = values.filter(F.col(value).isNotNull()).select(
            *keys, ts, tie, newest.alias(places[name]), F.lit(1).alias("_is_value"))
        union = union.unionByName(given, allowMissingColumns=True)
    rows = in_ranges(union, keys, ts, tie, ranges, folder)
    earlier = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, RANGE).agg(*[F.max(p).alias(p) for p in places.values()]).select(
        *keys, RANGE, *[F.max(p).over(earlier).alias(f"{p}_carry") for p in places.values()]
    )
    within = (
        W.partitionBy(*keys, RANGE).orderBy(ts, tie, "_is_value")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )

    def result(name, place):
        found = F.coalesce(F.col(f"{place}_seen"), F.col(f"{place}_carry"))
        fresh = F.lit(True)
        if ttl_seconds is not None:
            age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(found["at"].cast("timestamp"))
            fresh = age < F.lit(ttl_seconds * 1_000_000)
        return F.when(fresh, found["v"]).alias(name)

    kept = [c for c in lookups.columns if c not in places]
    return (
        rows.select("*", *[F.max(p).over(within).alias(f"{p}_seen") for p in places.values()])
        .filter(F.col("_is_value") == 0)
        .join(_carried_in(carry, keys), [*keys, RANGE], "left")
        .select(*kept, *[result(n, p) for n, p in places.items()])
    )
