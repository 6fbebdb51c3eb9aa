"""Lookups of values as a join of streams, by event time.

Lookups and values travel in one stream. A lookup waits in the state of its key until the watermark has passed
its time, when all earlier values within the allowed delay have come; then it gets the newest of them, unless that is
older than its time to live. So answers and expiry follow the rows' own times, not the clock of the run, and are the
same however the input is cut into batches. Values that no open lookup can need leave the state.

A key's values go to every shard, its lookups to one each, so a key with a third of all lookups has several states.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfwatch.operators.lookups import cached_value
from shelfwatch.rules import modules as M
from shelfwatch.streaming.attempt_streams import state_table, timed

SHARDS = 4
STATE = "l_micros array<long>, l_tie array<long>, v_micros array<long>, v_tie array<long>, v_value array<double>"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _AnsweredLookups(StatefulProcessor):
    """Per key: open lookups (micros, tie) and the values (micros, tie, value) they may need, both in order."""

    def __init__(self, ttl_seconds: int, key_names: list[str]):
        self.ttl, self.key_names = ttl_seconds * 1_000_000, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def _columns(self) -> list[np.ndarray]:
        held = self.held.get()
        return [np.asarray(c, t) for c, t in zip(held or ([],) * 5, [np.int64] * 4 + [np.float64])]

    def _keep(self, columns: list[np.ndarray]) -> None:
        if not len(columns[0]) and not len(columns[2]):
            self.held.clear()
            return
        self.held.update(tuple(c.tolist() for c in columns))
        if len(columns[0]):  # wake up when the first open lookup can be answered; the same time again is one timer
            self.handle.registerTimer(-(-int(columns[0][0]) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = self._columns()
        for batch in rows:
            given = batch["is_value"].to_numpy(bool)
            for n, (name, own) in enumerate([("micros", ~given), ("tie", ~given), ("micros", given), ("tie", given), ("value", given)]):
                columns[n] = np.concatenate([columns[n], batch[name].to_numpy(columns[n].dtype)[own]])
        lookups, values = np.lexsort(columns[1::-1]), np.lexsort(columns[3:1:-1])
        self._keep([columns[n][lookups if n < 2 else values] for n in range(5)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        columns = self._columns()
        l_micros, l_tie, v_micros, v_tie, v_value = columns
        due = int(np.searchsorted(l_micros, mark, "right"))
        # The newest value before each lookup, by (micros, tie): the order of both together, values after lookups of their place.
        order = np.lexsort((np.r_[np.ones(len(v_tie)), np.zeros(due)], np.r_[v_tie, l_tie[:due]], np.r_[v_micros, l_micros[:due]]))
        is_value = order < len(v_tie)
        newest = np.maximum.accumulate(np.where(is_value, order, -1))[~is_value]
        seen = newest >= 0
        found = np.full(due, np.nan)
        found[seen] = v_value[newest[seen]]
        fresh = seen.copy()
        fresh[seen] = l_micros[:due][seen] - v_micros[newest[seen]] < self.ttl
        # Of the values up to the watermark only the last can be seen by later lookups, and none past its time to live.
        old = max(int(np.searchsorted(v_micros, mark, "right")) - 1, int(np.searchsorted(v_micros, mark - self.ttl, "right")), 0)
        self._keep([l_micros[due:], l_tie[due:], v_micros[old:], v_tie[old:], v_value[old:]])
        if due:
            yield pd.DataFrame({
                **{n: [v] * due for n, v in zip(self.key_names, key)}, "micros": l_micros[:due], "tie": l_tie[:due],
                "value": pd.Series([v if ok else None for v, ok in zip(found.tolist(), fresh.tolist())], dtype="float64"),
            })

    def close(self) -> None:
        pass


def answered_lookups(
    stream: DataFrame, keys: list[str], ts: str, tie: str, is_lookup: str, value: str, late: str,
    ttl_seconds: int = M.CACHE_SECONDS, shards: int = SHARDS,
) -> DataFrame:
    """keys, shard, micros, tie and value of each lookup, once the watermark has passed it; value is NULL where none is fresh.

    A row of `stream` is a lookup where the column is_lookup holds, and gives a value where `value` is not NULL; it may be
    both, and then does not see its own. (ts, tie) must order the rows of a key; missing keys read as "" or 0 and
    missing times drop the row, as a watermark knows no place for it.
    """
    types = dict(stream.dtypes)
    for key in keys:
        stream = stream.withColumn(key, F.coalesce(F.col(key), F.lit("" if types[key] == "string" else 0).cast(types[key])))
    lookup, given = F.coalesce(F.col(is_lookup), F.lit(False)), F.col(value).isNotNull()
    own = F.pmod(F.xxhash64(tie), F.lit(shards)).cast("int")
    as_row = lambda is_value, shard: F.struct(F.lit(is_value).alias("is_value"), shard.alias("shard"))
    every = F.when(given, F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: as_row(True, s))).otherwise(F.array())
    rows = timed(stream.filter(F.col(ts).isNotNull()), ts, late).select(
        *keys, ts, F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"),
        F.inline(F.concat(F.when(lookup, F.array(as_row(False, own))).otherwise(F.array()), every)))
    rows = rows.withColumn("micros", F.unix_micros(ts))
    names = [*keys, "shard"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(*names).transformWithStateInPandas(
        _AnsweredLookups(ttl_seconds, names), f"{', '.join(f'{n} {types[n]}' for n in names)}, micros long, tie long, value double",
        "Append", "EventTime",
    )


def open_lookups(spark: SparkSession, checkpoint: str, keys: list[str], ttl_seconds: int = M.CACHE_SECONDS, folder: str | None = None) -> DataFrame:
    """The answers, so far, of the lookups that a stopped stream still held open: keys, shard, micros, tie, value."""
    state, names = state_table(spark, checkpoint, "held"), [*keys, "shard"]
    lookups = state.select(*names, F.inline(F.arrays_zip(F.col("l_micros").alias("micros"), F.col("l_tie").alias("tie"))))
    values = state.select(*names, F.inline(F.arrays_zip(F.col("v_micros").alias("micros"), F.col("v_tie").alias("tie"), F.col("v_value").alias("value"))))
    at = F.timestamp_micros("micros").alias("ts")
    found = cached_value(lookups.select("*", at), values.select("*", at), names, "value", ttl_seconds, "ts", "tie")
    return found.select(*names, "micros", "tie", "value")
