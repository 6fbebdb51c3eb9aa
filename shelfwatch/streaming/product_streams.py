"""Product streams: dedup by url and by (source, asin), in sequence, over the whole life of a stream.

One keyed state cannot say whether a row goes by one key before it registers the other, so the state here is
a table of what was kept, one folder a batch. A batch first drops rows that share a key with rows kept in
earlier batches, then settles its own rows in order, and writes what stays in its folder's place. A batch that is
run again after a failure reads earlier folders alone and replaces its own, so the table is the same.

Only the two key columns of the table are read. Where the batch's keys are few by a count, they are sent to the scan
of the table, and of the history only rows with one of them go on; else both sides meet in a shuffle.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from shelfwatch.operators.products import KEYS, deduplicated, with_keys

BATCH = "_batch"
FEW_KEYS = 100_000  # distinct keys of a batch that may be broadcast


class KeptProducts:
    """The rows a stream kept, below one path, by batch."""

    def __init__(self, spark: SparkSession, path: str, row_key: list[str], order: list[str] | None = None, page_url: str | None = None):
        self.spark, self.path, self.row_key, self.order, self.page_url = spark, path, row_key, order, page_url

    def _table(self, schema: StructType, before: int | None = None) -> DataFrame:
        keyed = StructType([*schema.fields, StructField(BATCH, LongType())])
        # An empty folder for batch -1, which no stream has, makes the table readable from the start.
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{BATCH}=-1")
        rows = self.spark.read.schema(keyed).parquet(self.path)
        return rows if before is None else rows.filter(F.col(BATCH) < before)

    def rows(self, schema: StructType) -> DataFrame:
        return self._table(schema).drop(BATCH)

    def known(self, batch: DataFrame, schema: StructType, number: int) -> DataFrame:
        """_id and _url of the rows kept before batch `number` that share a key with `batch`."""
        history = with_keys(self._table(schema, number), self.row_key, self.order, self.page_url).select(*KEYS)
        out = None
        for key in KEYS:
            own = batch.select(F.col(key).alias("_own")).filter("_own IS NOT NULL").distinct()
            own = F.broadcast(own) if own.limit(FEW_KEYS + 1).count() <= FEW_KEYS else own
            part = history.join(own, F.col(key) == F.col("_own"), "left_semi")
            part = part.select(*[F.col(k) if k == key else F.lit(None).cast("string").alias(k) for k in KEYS])
            out = part if out is None else out.unionByName(part)
        return out

    def add(self, batch: DataFrame, number: int) -> None:
        """Decide one batch and put what stays in its folder; may be repeated."""
        batch = batch.persist()  # used for its keys and for its rows; a lost block is read again from the source
        try:
            known = self.known(with_keys(batch, self.row_key, self.order, self.page_url), batch.schema, number)
            kept = deduplicated(batch, self.row_key, self.order, self.page_url, known=known)
            kept.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={number}")
        finally:
            batch.unpersist()


def distinct_products(
    stream: DataFrame, path: str, checkpoint: str, row_key: list[str], order: list[str] | None = None, page_url: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep a stream's distinct products below `path`; read them with KeptProducts.rows.

    Rows of a batch are ordered as in `deduplicated`; those of earlier batches come before. So where products
    arrive in order the table equals the batch result, however the stream is cut.
    """
    spark = stream.sparkSession
    table = KeptProducts(spark, path, row_key, order, page_url)

    def each(batch: DataFrame, number: int) -> None:
        table.add(batch, number)

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
