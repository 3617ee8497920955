"""B11 on a stream: live snapshots that hold more goals or cards than the last one, with state
that ends with the match.

A value state per match holds the counts last seen; an event-time timer, moved on by every
snapshot, clears it ``keep`` after the newest one once the watermark has passed. So the state
is the matches of the last hours, however long the stream runs. A snapshot older than the
watermark is dropped before it gets here; a match that is listed again after ``keep`` starts anew.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
COUNTS = T.StructType([T.StructField("goals", T.IntegerType()), T.StructField("cards", T.IntegerType()), T.StructField("expires", T.LongType())])


class SnapshotDiff(StatefulProcessor):
    def __init__(self, ts: str, keep_ms: int):
        self.ts, self.keep_ms = ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        goals, cards, expires = self.counts.get() if self.counts.exists() else (0, 0, None)
        new = pd.concat(list(rows)).sort_values(self.ts, kind="stable")     # one match's snapshots of one micro-batch
        more = []
        for g, c in zip(new["n_goals"], new["n_cards"], strict=True):
            more.append(bool(g > goals or c > cards))
            goals, cards = int(g), int(c)
        at = int(new[self.ts].max().timestamp() * 1000) + self.keep_ms
        if expires is None or at > expires:
            if expires is not None:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(at)
            expires = at
        self.counts.update((goals, cards, expires))
        yield new[more]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter([])

    def close(self) -> None:
        pass


def snapshot_changes_stream(snapshots: DataFrame, ts: str = "snapshot_ts", watermark: str = "10 minutes", keep_hours: float = 4.0) -> DataFrame:
    """Snapshots with n_goals and n_cards added, those only that hold more of either than the
    snapshot of the match before (by ``ts`` inside a micro-batch, by arrival across them)."""
    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s = (snapshots.withColumn("n_goals", F.size("goals")).withColumn("n_cards", F.size("cards")).withWatermark(ts, watermark))
    return s.groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=SnapshotDiff(ts, int(keep_hours * HOUR_MS)), outputStructType=s.schema, outputMode="Append", timeMode="EventTime")
