"""Verdicts that outlive a run: a table by status and text hash, so that each run classifies new texts only.

A run first asks a Bloom filter of the stored keys, a bitmap of fixed size built by an aggregate and sent to the scan. A
text whose bit is not set is new for certain and is classified where it is read. Texts whose bit is set give only
their key to a join with the table; the few of them that are not there after all are read and classified then.
So no text is shuffled, and known texts are hashed but not searched for phrases.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.responses import reasoned_code, reasoned_outcome
from shelfwatch.rules.modules import CACHE_SECONDS
from shelfwatch.session import work_folder

STORE_DDL = "status int, key string, code int, decided_at timestamp, run string"
BLOOM_BITS = 1 << 26  # 8 MB when all of it is used
PAGE_BITS = 32_768  # bits of one bitmap, as the aggregate makes them
FEW_IDS = 100_000  # ids that may be broadcast


def key_filter(keys: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """page, bitmap: which of `bits` places the keys (status, key) fall on. Bitmaps meet in the map tasks."""
    return keys.select(_place(bits).alias("place")).groupBy(F.floor(F.col("place") / PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(F.col("place") % PAGE_BITS).alias("bitmap"))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("status", "key"), F.lit(bits))


def maybe_among(rows: DataFrame, bloom: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """Rows with `maybe`: false if their (status, key) is certainly none of the filter's."""
    at = F.col("_place") % PAGE_BITS
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("_place", _place(bits))
    joined = placed.join(F.broadcast(bloom), F.floor(F.col("_place") / PAGE_BITS) == F.col("page"), "left")
    return joined.withColumn("maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_place", "page", "bitmap")


class VerdictStore:
    """Verdict codes by (status, key) below one path, one folder a run.

    The key is the hash of the whole text, or of its first `key_chars` characters; texts that share it share the verdict of
    the first of them, by run and then by id. A NULL status counts as -1 in keys, a NULL text as an empty one.
    """

    def __init__(self, spark: SparkSession, path: str, key_chars: int | None = None, ttl_seconds: int = CACHE_SECONDS, bits: int = BLOOM_BITS):
        self.spark, self.path, self.key_chars, self.ttl, self.bits = spark, path, key_chars, ttl_seconds, bits

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(STORE_DDL).parquet(self.path)
        except AnalysisException:  # nothing stored yet
            return self.spark.createDataFrame([], STORE_DDL)

    def fresh(self, now: Column, run: str | None = None) -> DataFrame:
        """status, key, code of the verdicts younger than the time to live, but for those of `run` itself; the newest of a key."""
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros("decided_at")
        rows = self.all().filter(age < self.ttl * 1_000_000)
        rows = rows if run is None else rows.filter(F.col("run") != run)
        return rows.groupBy("status", "key").agg(F.max_by("code", F.struct("decided_at", "run")).alias("code"))

    def _written(self, df: DataFrame, name: str, folder: str | None) -> DataFrame:
        path = work_folder(self.spark, name, folder)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def classify(self, responses: DataFrame, id_column: str, run: str, now: Column | None = None, folder: str | None = None) -> DataFrame:
        """id, status_code, verdict struct and origin ("stored" or "new") of every response; new verdicts are stored.

        `run` names the run; one that is repeated finds what other runs stored and replaces its own folder. Ids must
        be different. Tables of the run are written below `folder` or the shared folder.
        """
        now = F.current_timestamp() if now is None else now
        known = self._written(self.fresh(now, run), "known-verdicts", folder)
        text = F.coalesce("text", F.lit(""))
        own = responses.select(
            F.col(id_column).alias("id"), "status_code", text.alias("text"), F.coalesce("status_code", F.lit(-1)).cast("int").alias("status"),
            F.sha2(text if self.key_chars is None else F.left(text, F.lit(self.key_chars)), 256).alias("key"))
        # Lowered and searched only where the filter says that the text is new.
        flagged = maybe_among(own, key_filter(known, self.bits), self.bits).withColumn("lowered", F.when(~F.col("maybe"), F.lower("text")))
        code = F.when(~F.col("maybe"), reasoned_code(F.col("status_code"), F.col("text"), F.col("lowered")))
        rows = self._written(flagged.select("id", "status_code", "status", "key", "maybe", code.alias("own")), "verdict-rows", folder)
        found = rows.filter("maybe").join(known, ["status", "key"], "left")
        found = self._written(found.select("id", "status_code", "status", "key", "code"), "verdict-hits", folder)
        # The filter was wrong about these: about one in bits / keys.
        missed = found.filter("code IS NULL").select("id", "status_code", "status", "key")
        ids = missed.select("id")
        ids = F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids
        again = own.join(ids, "id", "left_semi").withColumn("lowered", F.lower("text"))
        again = again.select("id", "status_code", "status", "key", reasoned_code(F.col("status_code"), F.col("text"), F.col("lowered")).alias("own"))
        new = self._written(rows.filter("NOT maybe").drop("maybe").unionByName(again), "new-verdicts", folder)
        first = new.groupBy("status", "key").agg(F.min_by("own", "id").alias("code"), F.min("own").alias("lo"), F.max("own").alias("hi"))
        kept = first.select("status", "key", "code", now.cast("timestamp").alias("decided_at"), F.lit(run).alias("run"))
        kept.write.mode("overwrite").parquet(f"{self.path}/part={run}")
        # Only openings whose texts disagree come back, as in `shared_verdicts`.
        deciding = first.filter("lo <> hi").select("status", "key", "code")
        new = new.join(deciding, ["status", "key"], "left").select("id", "status_code", F.coalesce("code", "own").alias("code"), F.lit("new").alias("origin"))
        every = new.unionByName(found.filter("code IS NOT NULL").select("id", "status_code", "code", F.lit("stored").alias("origin")))
        return every.select(F.col("id").alias(id_column), "status_code", reasoned_outcome(F.col("code")).alias("verdict"), "origin")
