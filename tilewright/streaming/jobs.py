"""Incremental jobs in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import naming as N
from ..operators import caching, views
from ..sources import store
from ..sources.listing import stream_files


def stream_catalog(spark: SparkSession, directory: str) -> DataFrame:
    """Supported files of a directory as they appear: path, name, size, modified_ms, scanned_at.

    What has been seen is state on the executors, not a list on the driver; with ``STATE_STORE`` set, it need not fit memory.
    """
    named = stream_files(spark, directory).select("path", N.base_name(F.col("path")).alias("name"), "size", "modified_ms", F.current_timestamp().alias("scanned_at"))
    return named.where(N.is_supported(F.col("name")))


def newest_scan(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The catalog after a batch: of each path the row scanned last; a stale scan changes nothing."""
    rows = known.unionByName(batch)
    return rows.groupBy("path").agg(F.max_by(F.struct("name", "size", "modified_ms", "scanned_at"), F.struct("scanned_at", "modified_ms")).alias("r")).select("path", "r.*")


def stream_thumbnails(requests: DataFrame, store_path: str, build: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Build what is requested and not stored yet, each key once; returns the running query.

    ``requests``: cache_key, path, px.  A batch's repeats are folded, and its keys are held against the store,
    so no request is too late and no state grows.  What is built is published at once under its keys: a batch that is
    run again, or another job's, writes nothing twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        work = caching.request_dedup(batch).drop("waiting")
        if store.latest_version(store_path):
            work = caching.cache_miss(work, store.read_store(batch.sparkSession, store_path))
        store.publish(build(work), store_path)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: What the session has to set before a query of ``stream_lod`` starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Frames that go to the state at once.
FRAMES = 1000


class _Frames(StatefulProcessor):
    """A session's frames wait in a list until the watermark has passed them, and are then answered in order; the level is a
    value that goes when the session has been idle.  Times are event times, in milliseconds and microseconds."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, scale double, max_level int")
        self.level = handle.getValueState("level", "level int, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, first = [], None
        for r in rows:
            held.append((r["us"], r["event_id"], r["scale"], r["max_level"]))
            first = r["us"] if first is None else min(first, r["us"])
            if len(held) == FRAMES:
                self.waiting.appendList(held)
                held = []
        if held:
            self.waiting.appendList(held)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for r in self.waiting.get():
            (due if r[0] // 1000 <= now else rest).append(tuple(r))
        known = self.level.get() if self.level.exists() else None
        if due:
            due.sort(key=lambda r: r[:2])
            state = views.start_levels(known[0] if known else None)
            scales, most = (np.array([default if r[k] is None else r[k] for r in due], dtype=float) for k, default in ((2, np.nan), (3, 0)))
            answers = [state.step(*limits) for limits in zip(*views.frame_limits(scales, most))]
            seen = due[-1][0] // 1000
            self.level.update((state.end(), seen))
            self.handle.registerTimer(seen + self.idle_ms)
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest) // 1000)
            else:
                self.waiting.clear()
            for r, level in zip(due, answers):
                yield Row(session_id=key[0], event_id=r[1], level=level)
        elif known and not rest and known[1] + self.idle_ms <= now:
            self.level.clear()


def stream_lod(events: DataFrame, late: str = "0 seconds", idle_seconds: int = 3600) -> DataFrame:
    """session_id, event_id, level: each choice starts from the session's level kept in state.

    ``events``: session_id, event_id, ts (timestamp), scale, max_level.  Frames are answered in order of (ts, event_id)
    across batches: they wait until the watermark, ``late`` behind the newest frame, has passed them; frames later than
    that are dropped.  A session's state is its waiting frames and one number, and is removed after ``idle_seconds`` of
    event time, from when on the session begins anew.  A batch's frames go to the state in pieces.  ``STATE_STORE`` has to be set.
    """
    keyed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).withColumn("max_level", F.col("max_level").cast("int"))
    return keyed.groupBy("session_id").transformWithState(_Frames(1000 * idle_seconds), "session_id long, event_id long, level int", "Append", "EventTime")


def stream_tile_demand(events: DataFrame, images: DataFrame, tile_size: int, radius: int = 1) -> DataFrame:
    """session_id, event_id, image_id, z, tx, ty, ring for every view as it comes; stateless."""
    ranged = views.with_ranges(events.join(images, "image_id"), tile_size)
    r = F.col("range")
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    last = lambda side: F.ceil(F.ceil(F.col(side) / scale) / F.lit(tile_size)) - 1
    span = lambda a, b, side: F.when(F.greatest(F.lit(0).cast("long"), r[a] - radius) <= F.least(last(side), r[b] + radius), F.sequence(F.greatest(F.lit(0).cast("long"), r[a] - radius), F.least(last(side), r[b] + radius)))
    rows = ranged.withColumn("tx", F.explode(span("tx0", "tx1", "w"))).withColumn("ty", F.explode(span("ty0", "ty1", "h")))
    shown = F.col("tx").between(r["tx0"], r["tx1"]) & F.col("ty").between(r["ty0"], r["ty1"])
    return rows.select("session_id", "event_id", "image_id", F.col("level").alias("z"), "tx", "ty", (~shown).alias("ring"))
