"""Streams over the attempt log.

State is kept by (key, shard): the shard comes from the row's id, so one busy site or URL is
spread over several state partitions. Every state here can be merged exactly: counters add up, and
the last n of a key are among the last n of its shards.

The current values are read from the state store itself, as a table by the checkpoint (`state_table`): its
size goes with the keys, not with the batches run, and the stream needs no sink (`keep_state`). A stream that
feeds a sink instead emits what changed in each batch, and the `merged_*` functions read that.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import TimestampNTZType

from shelfwatch.operators.timeline import top_rows
from shelfwatch.rules import modules as M
from shelfwatch.sources.attempt_log import ATTEMPT_LINE_DDL, LOG_FILES, backfilled

SHARDS = 16

# The driver-side process that prepares stateful processors does not see shipped Python files, so
# the processors of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_attempts(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Attempt rows as JSON lines files land in the log folder."""
    return backfilled(
        spark.readStream.schema(ATTEMPT_LINE_DDL).option("pathGlobFilter", LOG_FILES)
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def append_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet, exactly once by its checkpoint."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time with its watermark. A zone-less time, which watermarks refuse, is read as UTC."""
    time = F.col(ts)
    if isinstance(stream.schema[ts].dataType, TimestampNTZType):
        time = F.convert_timezone(F.lit("UTC"), F.current_timezone(), time)
    return stream.withColumn(ts, time.cast("timestamp")).withWatermark(ts, late)


def windowed_stats(stream: DataFrame, ts: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Attempts by time window, site and block type. Partial counts combine before the shuffle."""
    return (
        timed(stream, ts, late)
        .groupBy(F.window(ts, width).alias("window"), "site", "block_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms"))
        .select(F.col("window.start").alias("window_start"), "site", "block_type", "n", "latency_ms")
    )


def open_windows(rows: DataFrame, emitted: DataFrame, ts: str, width: str = "1 day") -> DataFrame:
    """The windows of `rows`, a batch read of what was streamed, that a stopped stream still held open.

    A stream emits a window once the watermark has passed it, so the open ones start after the last emitted.
    """
    last = emitted.agg(F.max("window_start").alias("_last"))  # one row
    return windowed_stats(rows, ts, width).join(F.broadcast(last)).filter(
        F.col("_last").isNull() | (F.col("window_start") > F.col("_last"))).drop("_last")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows dropped as older than the watermark, over the whole run of the query.

    Spark keeps the progress of the last spark.sql.streaming.numRecentProgressUpdates batches; if a longer
    run has lost its first ones, this raises instead of counting less. `batch_ledger` counts runs of any length.
    """
    limit = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    if len(query.recentProgress) >= limit:
        raise ValueError(f"over {limit} batches: raise spark.sql.streaming.numRecentProgressUpdates")
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


def sharded(stream: DataFrame, row_id: str, shards: int = SHARDS) -> DataFrame:
    return stream.withColumn("shard", F.pmod(F.xxhash64(row_id), F.lit(shards)).cast("int"))


def distinct_within(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First row per key within the watermark. Rows with an empty key are the caller's to keep apart.

    One state per key, of which the expiry of the emitted row is all it holds.
    """
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def keep_state(stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stateful stream for its state alone."""
    return (
        stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def state_table(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable after the last batch of a checkpoint: its key and value columns, one row a key."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    timed_out = "ttlExpirationMs" in rows.schema["value"].dataType.names  # then the value proper lies one deeper
    return rows.select("key.*", "value.value.*" if timed_out else "value.*")


class _LastRows(StatefulProcessor):
    """Keeps the newest rows of a key as (micros, id, value) and two counters, in one value.

    With emit, gives once per batch the rows that entered the history in it, with the counters so far. A row is
    emitted at most once, so a reader has the history by ranking what was emitted. Rows arrive as
    key values and plain columns micros, row_id, value and success.
    """

    def __init__(self, kept: int, key_names: list[str], emit: bool):
        self.kept, self.key_names, self.emit = kept, key_names, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "state", "ok long, bad long, micros array<long>, row_id array<long>, value array<double>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        ok, bad, *columns = held if held is not None else (0, 0, [], [], [])
        micros, ids, values = (np.asarray(c, t) for c, t in zip(columns, (np.int64, np.int64, np.float64)))
        new = np.zeros(len(micros), bool)
        for batch in rows:
            good = batch["success"].to_numpy(bool)
            ok += int(good.sum())
            bad += int((~good).sum())
            micros = np.concatenate([micros, batch["micros"].to_numpy(np.int64)[good]])
            ids = np.concatenate([ids, batch["row_id"].to_numpy(np.int64)[good]])
            values = np.concatenate([values, batch["value"].to_numpy(np.float64)[good]])
            new = np.concatenate([new, np.ones(len(micros) - len(new), bool)])
            # Cut after every piece, so a long batch never piles up here.
            newest = np.lexsort((ids, micros))[-self.kept:]
            micros, ids, values, new = micros[newest], ids[newest], values[newest], new[newest]
        self.state.update((int(ok), int(bad), micros.tolist(), ids.tolist(), values.tolist()))
        if not self.emit:
            return
        width = max(int(new.sum()), 1)
        yield pd.DataFrame({
            **{n: [v] * width for n, v in zip(self.key_names, key)},
            "ok": [int(ok)] * width, "bad": [int(bad)] * width,
            "micros": micros[new].tolist() or [None], "row_id": ids[new].tolist() or [None],
            "value": values[new].tolist() or [None],
        })

    def close(self) -> None:
        pass


def last_rows_state(
    stream: DataFrame, keys: list[str], ts: str, row_id: str, value: str, kept: int, success: Column | None = None,
    shards: int = SHARDS, emit: bool = True,
) -> DataFrame:
    """Rolling state per (keys, shard): counters and the last rows, in the state variable "state".

    With success given, only successful rows enter the history; failures are counted alone. With emit, each
    batch also gives the counters and the rows that entered the history.
    """
    ok = F.lit(True) if success is None else success
    rows = sharded(stream, row_id, shards).select(
        *keys, "shard", F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"),
        F.col(row_id).cast("long").alias("row_id"), F.col(value).cast("double").alias("value"), ok.alias("success"),
    )
    names = [*keys, "shard"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_ddl = ", ".join(f"{n} {types[n]}" for n in names)
    return rows.groupBy(*names).transformWithStateInPandas(
        _LastRows(kept, names, emit),
        f"{key_ddl}, ok long, bad long, micros long, row_id long, value double", "Append", "None",
    )


def metrics_state(stream: DataFrame, ts: str = "ts", row_id: str = "event_id", emit: bool = True) -> DataFrame:
    """Last response times and counters per site."""
    return last_rows_state(
        stream, ["site"], ts, row_id, "latency_ms", M.RESPONSE_TIMES_KEPT, success=F.col("success"), emit=emit
    )


def history_state(
    stream: DataFrame, ts: str = "ts", row_id: str = "event_id", shards: int = 4, emit: bool = True,
) -> DataFrame:
    """Last attempts per URL. URLs are many and mostly small, so they get fewer shards than sites."""
    return last_rows_state(stream, ["url"], ts, row_id, "latency_ms", M.ATTEMPTS_KEPT, shards=shards, emit=emit)


def state_history(state: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """Last rows per key out of a state table of `last_rows_state`, newest first as history_rank 1."""
    rows = state.select(*keys, F.explode(F.arrays_zip("micros", "row_id", "value")).alias("_row")).select(*keys, "_row.*")
    return top_rows(rows, keys, ["micros", "row_id"], kept, rank="history_rank", shards=1)


def state_metrics(state: DataFrame) -> DataFrame:
    """Per site: mean seconds of the last successes, success rate and counts, out of a state table."""
    counts = state.groupBy("site").agg(F.sum("ok").alias("success_count"), F.sum("bad").alias("failure_count"))
    return _metrics(counts, state_history(state, ["site"], M.RESPONSE_TIMES_KEPT))


def merged_history(emitted: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """Last rows per key out of all emitted ones, newest first as history_rank 1."""
    rows = emitted.filter(F.col("row_id").isNotNull()).select(*keys, "micros", "row_id", "value")
    return top_rows(rows, keys, ["micros", "row_id"], kept, rank="history_rank")


def merged_metrics(emitted: DataFrame) -> DataFrame:
    """Per site: mean seconds of the last successes, success rate and counts.

    Counters only grow, so a shard's newest ones are its largest.
    """
    counts = (
        emitted.groupBy("site", "shard").agg(F.max("ok").alias("ok"), F.max("bad").alias("bad"))
        .groupBy("site").agg(F.sum("ok").alias("success_count"), F.sum("bad").alias("failure_count"))
    )
    return _metrics(counts, merged_history(emitted, ["site"], M.RESPONSE_TIMES_KEPT))


def _metrics(counts: DataFrame, history: DataFrame) -> DataFrame:
    means = history.groupBy("site").agg((F.avg("value") / 1000).alias("mean"))
    total = F.col("success_count") + F.col("failure_count")
    return counts.join(means, "site", "left").select(
        "site", F.coalesce("mean", F.lit(0.0)).alias("avg_response_time"),
        F.when(total == 0, 1.0).otherwise(F.col("success_count") / total).alias("success_rate"),
        "success_count", "failure_count", total.alias("total_requests"),
    )


class _NewestValue(StatefulProcessor):
    """Newest value of a key, dropped by the state store once its time to live is over.

    With emit, gives the held value once per batch.
    """

    def __init__(self, ttl_seconds: int, key_names: list[str], emit: bool):
        self.ttl, self.key_names, self.emit = ttl_seconds, key_names, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(
            "held", "micros long, row_id long, value double", ttlDurationMs=self.ttl * 1000
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        newest = None if held is None else tuple(held)
        for batch in rows:
            columns = [batch[c].to_numpy() for c in ("micros", "row_id", "value")]
            last = np.lexsort(columns[::-1])[-1]
            top = tuple(c[last].item() for c in columns)
            newest = top if newest is None else max(newest, top)
        newest = (int(newest[0]), int(newest[1]), float(newest[2]))
        self.held.update(newest)
        if not self.emit:
            return
        names = {n: [v] for n, v in zip(self.key_names, key)}
        yield pd.DataFrame({**names, "micros": [newest[0]], "row_id": [newest[1]], "value": [newest[2]]})

    def close(self) -> None:
        pass


def cached_state(
    stream: DataFrame, keys: list[str], ts: str, row_id: str, value: str, ttl_seconds: int = M.CACHE_SECONDS,
    emit: bool = True,
) -> DataFrame:
    """Newest value per (keys, shard), in the state variable "held", with a time to live; with emit also after each batch.

    With an available-now trigger switch spark.sql.streaming.noDataMicroBatches.enabled off: state
    with a time to live always asks for one more batch.
    """
    rows = sharded(stream.filter(F.col(value).isNotNull()), row_id).select(
        *keys, "shard", F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"),
        F.col(row_id).cast("long").alias("row_id"), F.col(value).cast("double").alias("value"),
    )
    names = [*keys, "shard"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_ddl = ", ".join(f"{n} {types[n]}" for n in names)
    return rows.groupBy(*names).transformWithStateInPandas(
        _NewestValue(ttl_seconds, names, emit), f"{key_ddl}, micros long, row_id long, value double",
        "Append", "ProcessingTime",
    )


def merged_cache(held: DataFrame, keys: list[str], now: Column, ttl_seconds: int = M.CACHE_SECONDS) -> DataFrame:
    """Value per key that is still fresh at `now`, by event time, out of emitted rows or of the state table."""
    age = F.unix_micros(now.cast("timestamp")) - F.col("micros")
    return (
        held.groupBy(*keys)
        .agg(F.max(F.struct("micros", "row_id", "value")).alias("_top"))
        .select(*keys, "_top.micros", "_top.value")
        .filter(age < ttl_seconds * 1_000_000)
    )
