"""Loss plateaus as keyed state with ``transformWithStateInPandas`` on the RocksDB store.

A run's state is a value (lowest loss, its first step, counts) and a map from step bucket to the steps seen in it,
so a micro-batch reads and writes only the buckets that its rows touch. The result depends on the set
of steps alone: rows may come in any order, and a step seen before is a replay and is passed over."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "run_dir string, best_loss double, steps_since_best long, n_steps long, closed boolean"
#: Steps of one bucket: their low bits are kept as 2 bytes each.
BUCKET_BITS = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PlateauProcessor(StatefulProcessor):
    """``idle_ms``: a run without a new event time for so long is closed by an event-time timer: its last
    row comes out once more with ``closed``, and its state goes. ``ttl_ms``: in processing time, each part of the
    state goes when it was not written for so long."""

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "loss double, at long, after long, n long, until long", self.ttl_ms)
        self.seen = handle.getMapState("seen", "bucket long", "low binary", self.ttl_ms)

    def _bucket(self, bucket: int) -> np.ndarray:
        key = (bucket,)
        return np.frombuffer(self.seen.getValue(key)[0], np.uint16) if self.seen.containsKey(key) else np.zeros(0, np.uint16)

    def _fresh(self, steps: np.ndarray) -> np.ndarray:
        """Marks the steps (distinct) that the run has not logged before, and notes them."""
        out = np.zeros(len(steps), bool)
        buckets, low = steps >> BUCKET_BITS, (steps & ((1 << BUCKET_BITS) - 1)).astype(np.uint16)
        for b in np.unique(buckets):
            here = np.flatnonzero(buckets == b)
            known = self._bucket(int(b))
            new = here[~np.isin(low[here], known)]
            if len(new):
                self.seen.updateValue((int(b),), (np.union1d(known, low[new]).tobytes(),))
                out[new] = True
        return out

    def _count_after(self, at: int) -> int:
        """Steps above ``at``: only asked when the best step changes."""
        total, first = 0, at >> BUCKET_BITS
        for (b,), (raw,) in self.seen.iterator():
            if b == first:
                total += int((np.frombuffer(raw, np.uint16) > (at & ((1 << BUCKET_BITS) - 1))).sum())
            elif b > first:
                total += len(raw) // 2
        return total

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        loss, at, after, n, until = self.best.get() if self.best.exists() else (float("inf"), 0, 0, 0, -1)
        for frame in rows:
            if self.idle_ms and "ts" in frame and frame["ts"].notna().any():
                until = max(until, int(frame["ts"].max().timestamp() * 1000) + self.idle_ms)
            frame = frame.dropna(subset=["step"]).drop_duplicates("step")
            steps = frame["step"].to_numpy(np.int64)
            fresh = self._fresh(steps)
            n += int(fresh.sum())
            known = frame[fresh].dropna(subset=["loss"]).sort_values(["loss", "step"])
            moved = len(known) and (float(known["loss"].iloc[0]), int(known["step"].iloc[0])) < (loss, at)
            if moved:
                loss, at = float(known["loss"].iloc[0]), int(known["step"].iloc[0])
                after = self._count_after(at)
            else:
                after += int((steps[fresh] > at).sum())
        self.best.update((loss, at, after, n, until))
        if self.idle_ms and until >= 0:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(until)
        yield self._row(key, loss, after, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.best.exists():
            loss, _, after, n, _ = self.best.get()
            self.best.clear()
            self.seen.clear()
            yield self._row(key, loss, after, n, True)

    @staticmethod
    def _row(key, loss: float, after: int, n: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"run_dir": [key[0]], "best_loss": [loss], "steps_since_best": [after], "n_steps": [n], "closed": [closed]})

    def close(self) -> None:
        pass


def plateau_detector(steps: DataFrame, idle: str | None = None, delay: str = "1 hour", ttl_ms: int | None = None) -> DataFrame:
    """``run_dir, best_loss, steps_since_best, n_steps, closed`` of every run that a micro-batch updated.

    ``steps`` has ``run_dir, step, loss`` and, with ``idle``, the event time ``ts``, watermarked by ``delay``. Losses that are
    null count as steps without a loss; null steps are passed over; before the first loss ``best_loss`` is
    infinite and the best step counts as 0. Run it within ``rocksdb_state``."""
    idle_ms = int(steps.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {idle})").first()[0]) if idle else None
    cols = ["run_dir", F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"), *(["ts"] if idle else [])]
    rows = (steps.withWatermark("ts", delay) if idle else steps).select(*cols)
    mode = "EventTime" if idle else "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("run_dir").transformWithStateInPandas(PlateauProcessor(idle_ms, ttl_ms), OUT, "Update", mode)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's own choice comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
