"""Keyed state over streams with event-time timers: ordered decisions, window totals, and replay of a table as a stream.

State is kept by transformWithState in RocksDB, so a key's state need not fit in memory, and goes when it is of no use:
by a timer in event time, or by a time to live in processing time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memoryloom.sources.scratch import Scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Decides the rows of a key in the order of (at, order), however they arrive within the watermark's delay.

    Rows wait in a list until the watermark has passed them, when no earlier one can come; then step(state, row), a
    function of the small state of a key and a row, decides each. until(state) is the instant in microseconds from
    which a key's state is of no use; once the watermark is past it the state is removed. at is in microseconds.
    """

    def __init__(self, columns: list[str], schema: str, order: str, step: Callable[[dict, dict], Any], until: Callable[[dict], int], out: str):
        self.columns, self.schema, self.order, self.step, self.until, self.out = columns, schema, order, step, until, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.held = handle.getValueState("held", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            self.waiting.appendList(list(map(tuple, f[self.columns].astype(object).itertuples(index=False))))
            first = min([int(f["at"].min()), *([] if first is None else [first])])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # Rows before the watermark are complete: later ones of theirs would be late.
        now, at = timerValues.getCurrentWatermarkInMs(), self.columns.index("at")
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[at] < now * 1000]
        state = json.loads(self.held.get()[0]) if self.held.exists() else {}
        if ready:
            by = self.columns.index(self.order)
            ready.sort(key=lambda r: (r[at], r[by]))
            named = [dict(zip(self.columns, r)) for r in ready]
            values = [self.step(state, r) for r in named]
            rest = [r for r in rows if r[at] >= now * 1000]
            self.held.update((json.dumps(state),))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[at] for r in rest) // 1000 + 1)
            else:
                self.waiting.clear()
                self.handle.registerTimer(max(self.until(state) // 1000, now) + 1)
            frame = pd.DataFrame(named)
            frame[self.out] = values
            yield frame
        elif not rows and state and self.until(state) < now * 1000:
            self.held.clear()


class WindowTotals(StatefulProcessor):
    """Count, denials, sum and greatest latency of a key in each window of so many microseconds; a window is emitted and forgotten once it is over."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "start long", "n long, denials long, total long, most long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for f in rows:
            for start, g in f.groupby(f["at"] // self.width * self.width):
                mine = (int(start),)
                old = self.totals.getValue(mine) if self.totals.containsKey(mine) else None
                n, denials, total, most = old or (0, 0, 0, 0)
                self.totals.updateValue(mine, (n + len(g), denials + int((~g["allowed"]).sum()), total + int(g["latency_micros"].sum()), max(most, int(g["latency_micros"].max()))))
                self.handle.registerTimer((int(start) + self.width) // 1000)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.width,)
        if self.totals.containsKey(start):
            yield pd.DataFrame([(key[0], *start, *self.totals.getValue(start))], columns=["operation", "start", "count", "denials", "total_micros", "max_micros"])
            self.totals.removeKey(start)


class FirstUse(StatefulProcessor):
    """Passes the first row of a key and remembers the key for a time to live after its last row, in processing time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for f in rows:
            if not known and len(f):
                known = True
                yield f.iloc[:1]
        self.seen.update((True,))


def in_order(rows: DataFrame, keys: list[str], order: str, step: Callable[[dict, dict], Any], until: Callable[[dict], int], out: str) -> DataFrame:
    """rows (keys, order, at in microseconds and what step reads) with out ('name type'), as in Ordered; needs a watermark."""
    event_time = [f.name for f in rows.schema if "timestamp" in f.dataType.simpleString()]
    columns = [c for c in rows.columns if c not in event_time]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    name, _ = out.split()
    return rows.groupBy(*keys).transformWithStateInPandas(Ordered(columns, schema, order, step, until, name), f"{schema}, {out}", "Append", "EventTime")


def window_totals(samples: DataFrame, width: int) -> DataFrame:
    """operation, start (microseconds) and totals of samples (operation, at, allowed, latency_micros); needs a watermark."""
    out = "operation string, start long, count long, denials long, total_micros long, max_micros long"
    return samples.groupBy("operation").transformWithStateInPandas(WindowTotals(width), out, "Append", "EventTime")


def first_uses(requests: DataFrame, keys: list[str], ttl_ms: int) -> DataFrame:
    """The first request of each key; a key that was idle for the time to live is new again."""
    return requests.groupBy(*keys).transformWithStateInPandas(FirstUse(ttl_ms), requests.schema, "Append", "ProcessingTime")


def run(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, timers: bool = True) -> None:
    """Takes in all that there is of a stream, into Parquet files; the state store is RocksDB for this run.

    timers: batches without data follow, in which event-time timers fire. State in processing time asks for ever more
    of them, so a run to the end of its data has to do without.
    """
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower()}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def replayed(spark: SparkSession, rows: DataFrame, flow: Callable[[DataFrame], DataFrame], late: str = "1 hour", files: int = 1) -> DataFrame:
    """What flow makes of rows (with a timestamp ts) that arrive as a stream, files at a time, and of nothing after them.

    A last row far in the future moves the watermark past all others. Input and checkpoints are deleted, the result stays.
    """
    with Scratch(spark, "replay") as scratch:
        source, end, checkpoint = scratch.path(), scratch.path(), scratch.path()
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
        rows.repartition(files).write.parquet(source)
        last = rows.limit(1).withColumn("ts", (F.col("ts") + F.expr("interval 100 years")).cast(rows.schema["ts"].dataType))
        if "at" in rows.columns:
            last = last.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
        last.write.parquet(end)
        stream = spark.readStream.schema(rows.schema).parquet(source).unionByName(spark.readStream.schema(rows.schema).parquet(end))
        made = flow(stream.withWatermark("ts", late))
        found = scratch.path()
        run(spark, made, found, checkpoint)
        return scratch.keep(spark.read.schema(made.schema).parquet(found))
