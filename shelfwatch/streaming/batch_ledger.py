"""A ledger of a stream's batches: rows in, rows dropped as too late, and the watermark, one row a batch.

Spark keeps the progress of the last hundred batches only, in memory. A listener writes every batch's numbers to a
table as they come, so the counts hold for a stream of any length and after its end.
"""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

LEDGER_DDL = "query_id string, batch long, rows_in long, rows_dropped long, watermark timestamp"


class BatchLedger(StreamingQueryListener):
    """Writes the batches of the queries named `name` (all queries without one) below `path`.

    `every` batches share a file; the rest is written when the query ends. Files are named by query and first batch, so a batch
    that is reported again replaces its row.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, every: int = 1):
        self.spark, self.path, self.name, self.every = spark, path, name, every
        self._held: dict[str, list[tuple]] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is not None and p.name != self.name:
            return
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        mark = (p.eventTime or {}).get("watermark")
        own = self._held.setdefault(str(p.id), [])
        own.append((str(p.id), p.batchId, p.numInputRows, dropped, mark))
        if len(own) >= self.every:
            self._write(str(p.id))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(str(event.id))
        self._ended.add(str(event.runId))

    def _write(self, query: str) -> None:
        rows = self._held.pop(query, [])
        if rows:
            df = self.spark.createDataFrame(rows, "query_id string, batch long, rows_in long, rows_dropped long, mark string")
            df = df.select("query_id", "batch", "rows_in", "rows_dropped", F.to_timestamp("mark").alias("watermark"))
            df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/file={query}-{rows[0][1]:012d}")

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all batches of an ended run are written; events arrive a little after the batch."""
        end = time.monotonic() + seconds
        while str(query.runId) not in self._ended:
            if time.monotonic() > end:
                raise TimeoutError(f"the end of query {query.id} was not reported within {seconds} s")
            time.sleep(0.05)

    def rows(self) -> DataFrame:
        """One row a batch; of a batch reported twice, as after a restart, the last report."""
        files = self.spark.read.schema(f"{LEDGER_DDL}, file string").parquet(self.path)
        last = F.max(F.struct("file", "rows_in", "rows_dropped", "watermark")).alias("last")
        return files.groupBy("query_id", "batch").agg(last).select("query_id", "batch", "last.rows_in", "last.rows_dropped", "last.watermark")


def with_ledger(ledger: BatchLedger, start) -> StreamingQuery:
    """Run the query that start() begins to its end, with its batches in the ledger."""
    ledger.spark.streams.addListener(ledger)
    try:
        query = start()
        query.awaitTermination()
        ledger.wait(query)
        return query
    finally:
        ledger.spark.streams.removeListener(ledger)
