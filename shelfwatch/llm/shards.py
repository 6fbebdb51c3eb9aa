"""Sharding by fixed virtual slots.

A record is hashed into one of SLOTS slots for good. What moves between shards is slots: a versioned
slot-to-shard map, at most SLOTS rows a version, is stored as Parquet. The first version deals the slots
out by their bytes, heaviest first, each to the lightest shard so far; a rebalance writes a new version
that moves as many slots as needed into the new shards and nothing else. Law: `bytes`.

Defined results: a NULL text has no bytes (size 1, checksum 0); NULL ids and repeated rows are records
like any other, spread by id and text; an empty table gives an empty map and no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import text_of

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot. The text itself is not carried any further."""
    text = text_of()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """version, vslot, shard, bytes, rows. The fold runs over at most SLOTS entries."""

    def give(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda v, i: v + F.when(i == lightest, slot["bytes"]).otherwise(0)).alias("loads"),
            F.concat(state["dealt"], F.array(F.struct(slot["vslot"], lightest.alias("shard"), slot["bytes"], slot["rows"]))).alias("dealt"),
        )

    entry = "array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>"
    heaviest_first = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes", "rows")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast(entry).alias("dealt"))
    dealt = F.aggregate(heaviest_first, start, give, lambda s: s["dealt"])
    return sizes.agg(dealt.alias("dealt")).select(F.lit(1).alias("version"), F.inline("dealt"))


def rebalanced(current: DataFrame, shards: int) -> DataFrame:
    """The next version: from every shard, the slots beyond an equal share go to the new shards.

    `current` is one version; its largest shard is taken as the last old one. Slots move only into new
    shards, in turn.
    """
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    ahead = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot"))
    old = F.max("shard").over(Window.partitionBy()) + 1
    marked = current.select("*", old.alias("_old"), (ahead > share).alias("_moves"))
    turn = F.row_number().over(Window.partitionBy("_moves").orderBy(F.col("bytes").desc(), "vslot")) - 1
    target = F.col("_old") + F.pmod(turn, F.greatest(F.lit(shards) - F.col("_old"), F.lit(1)))
    moved = F.when(F.col("_moves") & (F.col("_old") < shards), target).otherwise(F.col("shard"))
    return marked.select((F.col("version") + 1).alias("version"), "vslot", moved.cast("int").alias("shard"), "bytes", "rows")


def store_map(version: DataFrame, folder: str) -> None:
    """Adds one version; a version number that is there already is an error of the caller."""
    version.coalesce(1).write.mode("append").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version, by default the newest."""
    every = spark.read.parquet(folder)
    if version is not None:
        return every.filter(F.col("version") == version)
    newest = F.max("version").over(Window.partitionBy())
    return every.select("*", newest.alias("_newest")).filter("version = _newest").drop("_newest")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and slot: the row's place in its shard, gapless from 0.

    Places are counted within virtual slots, so no task sorts a shard; the map adds each slot's start.
    """
    start = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    starts = slot_map.select(F.col("vslot").alias("_vslot"), "shard", start.alias("_start"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32"))
    numbered = rows.withColumn("_place", place)
    # The map has at most SLOTS rows, whatever the input.
    return numbered.join(F.broadcast(starts), numbered["vslot"] == starts["_vslot"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_place") - 1).alias("slot"), "vslot",
    )
