"""Selector template table: Parquet, partitioned by site and page type, with a time to live on use."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators.nodes import default_template
from shelfwatch.rules.modules import CACHE_SECONDS
from shelfwatch.rules.selectors import TEMPLATE_FIELDS
from shelfwatch.session import work_folder

KEYS = ["site", "page_type"]
TEMPLATE_TABLE_DDL = ", ".join(
    [*(f"{f} string" for f in TEMPLATE_FIELDS), "loaded_at timestamp", "deleted boolean", "site string", "page_type string"]
)


class TemplateTable:
    """Templates by (site, page_type) below one path.

    A save overwrites only the partitions it brings. A delete marks its keys' partitions the same way,
    so neither rewrites the table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, templates: DataFrame, at: Column | None = None) -> None:
        """Store rows of site, page_type and selector columns, stamped with the time, or with `at`."""
        stamp = F.current_timestamp() if at is None else at
        rows = templates.select(*TEMPLATE_FIELDS, stamp.cast("timestamp").alias("loaded_at"), F.lit(False).alias("deleted"), *KEYS)
        self._overwrite(rows.hint("rebalance", *KEYS))

    def _overwrite(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)

    def all(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(TEMPLATE_TABLE_DDL).parquet(self.path)
        except AnalysisException:  # nothing saved yet
            rows = self.spark.createDataFrame([], TEMPLATE_TABLE_DDL)
        return rows.filter(~F.col("deleted")).drop("deleted")

    def load(self, site: str, page_type: str = "search") -> DataFrame:
        """The key's row, or none; partition pruning reads one folder."""
        return self.all().filter((F.col("site") == site) & (F.col("page_type") == page_type))

    def exists(self, site: str, page_type: str = "search") -> bool:
        return not self.load(site, page_type).isEmpty()

    def delete(self, keys: DataFrame) -> None:
        """Remove the given (site, page_type) rows by putting a marker in their partitions."""
        markers = keys.select(*KEYS).distinct().select(
            *[F.lit(None).cast("string").alias(f) for f in TEMPLATE_FIELDS],
            F.current_timestamp().alias("loaded_at"), F.lit(True).alias("deleted"), *KEYS,
        )
        self._overwrite(markers)

    def sites(self) -> DataFrame:
        return self.all().select("site").distinct()

    def resolve(
        self, keys: DataFrame, generated: DataFrame | None = None, now: Column | None = None, ttl_seconds: int = CACHE_SECONDS,
        folder: str | None = None,
    ) -> DataFrame:
        """site, page_type, origin and template of every key, and new templates stored back.

        keys may have two flags beside site and page_type: has_sample (a page is at hand) and force. A row stored less than
        `ttl_seconds` before `now` is taken as it is ("cached"); an older one only for a key with a sample ("stored"),
        and neither is stamped anew. All other keys, and those forced, take their row of `generated`
        ("generated") or the site's default ("default"), which is stored with `now` in place of what was there.

        The answer is written first, below `folder` or the shared folder; the new rows then replace their own
        partitions from it. A job lost in between is run again: it answers the same, for the same `now`, or finds its own rows.
        """
        stamp = F.current_timestamp() if now is None else now.cast("timestamp")
        flag = lambda c: F.coalesce(F.max(F.col(c).cast("boolean")), F.lit(False)) if c in keys.columns else F.max(F.lit(False))
        asked = keys.groupBy(*KEYS).agg(flag("has_sample").alias("has_sample"), flag("force").alias("force"))
        whole = lambda name: F.struct(*TEMPLATE_FIELDS).alias(name)
        held = self.all().select(*KEYS, whole("_held"), "loaded_at")
        found = asked.join(held, KEYS, "left")
        if generated is None:
            found = found.withColumn("_new", F.lit(None).cast(found.schema["_held"].dataType))
        else:
            found = found.join(generated.select(*KEYS, whole("_new")), KEYS, "left")
        age = F.unix_micros(stamp) - F.unix_micros("loaded_at")
        usable = F.col("_held").isNotNull() & ~F.col("force")
        origin = (
            F.when(usable & (age < ttl_seconds * 1_000_000), "cached").when(usable & F.col("has_sample"), "stored")
            .when(F.col("_new").isNotNull(), "generated").otherwise("default")
        )
        held_on = F.col("origin").isin("cached", "stored")
        answer = found.withColumn("origin", origin).select(
            *KEYS, "origin", F.when(held_on, F.col("_held")).otherwise(F.coalesce("_new", default_template(F.col("site")))).alias("template"),
            F.when(held_on, F.col("loaded_at")).otherwise(stamp).alias("loaded_at"))
        path = work_folder(self.spark, "resolved-templates", folder)
        answer.write.parquet(path)
        answer = self.spark.read.schema(answer.schema).parquet(path)
        fresh = answer.filter(~held_on)
        if not fresh.isEmpty():
            self._overwrite(fresh.select("template.*", "loaded_at", F.lit(False).alias("deleted"), *KEYS).hint("rebalance", *KEYS))
        return answer
