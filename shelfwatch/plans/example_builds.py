"""Example sets over a growing log: each version reads the files that came since the one before it.

A build lists the log folder and enters files not seen yet, with their bytes and lines, in a ledger. A module that is
ready then reads just the files entered since its last version, and writes their examples as the next one. So a
version is its own examples and those of its parents, and no file is read twice for a module.

Files are taken as finished when they are listed: a crawler that appends to a file must rotate it first. A file of
the ledger whose size has changed stops the build.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators import examples as ox
from shelfwatch.schemas import ATTEMPT_LINE_DDL
from shelfwatch.sources.attempt_log import LOG_FILES, backfilled

FILE_DDL = "file string, bytes long, lines long, build int"
VERSION_DDL = "module string, version int, parent int, after_build int, files long, bytes_read long, rows long, total_traces long, built_at timestamp, build int"
# Keys that a log may have beside those of every attempt.
EXAMPLE_KEYS = ["initial_level", "start_level", "difficulty_hint", "failure_history", "confidence", "reasoning"]
BUILDERS = {"strategy_selector": ox.outcome_examples, "initial_tier_selector": ox.level_examples}


class ExampleBuilds:
    """The ledger, the versions and the examples below one path."""

    def __init__(self, spark: SparkSession, path: str, log: str, builders: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.path, self.log, self.builders = spark, path, log, builders or BUILDERS

    def _table(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing built yet
            return self.spark.createDataFrame([], ddl)

    def files(self) -> DataFrame:
        return self._table("files", FILE_DDL)

    def versions(self) -> DataFrame:
        return self._table("versions", VERSION_DDL)

    def examples(self, module: str, version: int | None = None) -> DataFrame:
        """The examples of a version with those of its parents; of the newest one by default."""
        rows = self.spark.read.parquet(f"{self.path}/examples/module={module}")
        return rows if version is None else rows.filter(F.col("version") <= version)

    def _listed(self) -> DataFrame:
        """file, bytes of the log folder; only names and sizes are read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", LOG_FILES).load(self.log)
        return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))

    def _attempts(self, files: list[str]) -> DataFrame:
        extra = "".join(f", {k} string" for k in EXAMPLE_KEYS)
        ddl = ATTEMPT_LINE_DDL + extra
        return backfilled(self.spark.read.schema(ddl).json(files) if files else self.spark.createDataFrame([], ddl))

    def _enter(self, build: int) -> None:
        """Enter the files that are new, with their lines, as `build`."""
        known = self.files()
        listed = self._listed()
        changed = listed.join(known.withColumnRenamed("bytes", "_bytes"), "file").filter("bytes <> _bytes").limit(5).collect()
        if changed:
            raise ValueError(f"log files that changed after they were read: {[r.file for r in changed]}")
        new = listed.join(known, "file", "left_anti")
        # Names of new files go to the driver, as any reader's file list does.
        names = [r.file for r in new.select("file").collect()]
        if not names:
            return
        lines = self.spark.read.text(names).filter(F.trim("value") != "")
        counts = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
        counted = new.join(counts, "file", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
        counted.select("file", "bytes", "lines", F.lit(build).alias("build")).write.mode("overwrite").parquet(f"{self.path}/files/part={build}")

    def build(self, now: Column) -> DataFrame:
        """One build at `now`: the readiness report, one row a module. Ready modules with a builder get a new version.

        Files are entered first and versions last, each in its build's own folder. A build lost in between leaves
        its files entered and no version, and the next one goes on from there.
        """
        newest = [t.agg(F.max("build")).first()[0] or 0 for t in (self.files(), self.versions())]
        build = max(newest) + 1
        self._enter(build)
        files = self.files()
        total = files.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_traces"))
        made = self.versions()
        states = made.groupBy("module").agg(
            F.max("version").alias("version"), F.max("built_at").alias("last_built"), F.max_by("total_traces", "version").alias("last_built_rows"))
        report = ox.readiness_of(total, states, now)
        asked = report.collect()  # a row a module, a fixed list
        last = {r.module: r.build for r in made.groupBy("module").agg(F.max("build").alias("build")).collect()}
        rows = []
        for row in asked:
            if not row.ready or row.module not in self.builders:
                continue
            after = last.get(row.module, 0)
            own = files.filter(F.col("build") > after).select("file", "bytes").collect()
            version = row.version + 1
            found = self.builders[row.module](self._attempts([r.file for r in own]))
            path = f"{self.path}/examples/module={row.module}/version={version}"
            found.write.mode("overwrite").parquet(path)
            count = self.spark.read.parquet(path).count()
            rows.append((row.module, version, row.version or None, after, len(own), sum(r.bytes for r in own), count, row.total_traces, None, build))
        if rows:
            done = self.spark.createDataFrame(rows, VERSION_DDL).withColumn("built_at", now.cast("timestamp"))
            done.write.mode("overwrite").parquet(f"{self.path}/versions/part={build}")
        return self.spark.createDataFrame(asked, report.schema)
