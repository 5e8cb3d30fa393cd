"""The engine's operators over streams of detections, points and values; states are small and keyed by scene and label."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loculus.functions.geometry import voxel_floor
from loculus.operators.tracking import COLUMNS, Tracks


#: What transformWithStateInPandas keeps its states in.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK = "sx double, sy double, sz double, n long, first long, last long, conf double, seen long"


class TrackProcessor(StatefulProcessor):
    """The tracks of one scene and label, each an entry of its own; a timer for each ends those that are not seen any more."""

    def __init__(self, distance: float, lost: int, idle_ms: int):
        self.distance, self.lost, self.idle_ms = distance, lost, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "instance string", TRACK)
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        part = pd.concat(list(rows)).sort_values(["frame_order", "det_ord"])
        tracks, before = Tracks(key[1], self.distance, self.lost), {}
        for (name,), t in self.tracks.iterator():
            before[name] = t[7]
            tracks.tracks[name] = {"sum": list(t[:3]), "n": t[3], "first": t[4], "last": t[5], "conf": t[6]}
        tracks.made = self.made.get()[0] if self.made.exists() else 0
        at: dict[int, int] = {}
        for frame, own in part.groupby("frame_order", sort=True):
            tracks.update(int(frame), own[["x", "y", "z"]].to_numpy(), own["confidence"].to_numpy())
            at[int(frame)] = int(own["ts"].max().timestamp() * 1000)
        self.made.update((tracks.made,))
        for name in before.keys() - tracks.tracks.keys():
            self.tracks.removeKey((name,))
        for name, t in tracks.tracks.items():
            seen = max(at.get(t["last"], 0), before.get(name, 0))
            self.tracks.updateValue((name,), (*t["sum"], t["n"], t["first"], t["last"], t["conf"], seen))
            if seen != before.get(name):
                self.handle.registerTimer(seen + self.idle_ms)
        yield self.rows(key, tracks.rows(), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, gone, left = expiredTimerInfo.getExpiryTimeInMs(), [], False
        for (name,), t in list(self.tracks.iterator()):
            if t[7] + self.idle_ms > now:
                left = True
                continue
            if t[3] > 1:
                gone.append((name, t[4], t[5], t[3], *[v / t[3] for v in t[:3]], t[6] / t[3]))
            self.tracks.removeKey((name,))
        if not left:
            self.made.clear()
        yield self.rows(key, gone, True)

    @staticmethod
    def rows(key: tuple, rows: list[tuple], ended: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["instance", "first_seen", "last_seen", "n", "mx", "my", "mz", "confidence"])
        return out.assign(scene=key[0], label=key[1], ended=ended)


def stream_tracks(det: DataFrame, distance: float = 1.0, lost: int = 10, idle: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Tracks of each scene and label after each batch (update mode); det has the column ts (event time) besides those of detections.

    Frames of a key are taken in order within a batch; a track with one detection is given up where frames go on for over `lost` frames
    without it. A track that is not seen for `idle` of event time ends: with one detection it is forgotten, otherwise it is returned
    once more, as ended, and then forgotten. Its timer fires for silent keys, too, so the state is bounded by what is in view; a key of
    which nothing is left numbers its tracks from 1 again. The session's state store must be RocksDB.
    """
    spark = det.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = det.select(F.col("scene").cast("long").alias("scene"), "label", F.col("frame_order").cast("long").alias("frame_order"), "det_ord", "x", "y", "z", "confidence", "ts").withWatermark("ts", late)
    return rows.groupBy("scene", "label").transformWithStateInPandas(TrackProcessor(distance, lost, idle_ms), f"{COLUMNS}, scene long, label string, ended boolean", "Update", "EventTime")


def stream_kalman(det: DataFrame) -> DataFrame:
    """Filtered places of labels: since the filter's end state is a weighted mean, plain sums in update mode."""
    p = 1 / (F.col("position_uncertainty") * F.col("position_uncertainty"))
    return det.groupBy("scene", "label").agg(*[(F.sum(p * F.col(c)) / F.sum(p)).alias(f"m{c}") for c in "xyz"], F.sqrt(3 / F.sum(p)).alias("sigma"), F.count(F.lit(1)).alias("n"))


def stream_voxels(points: DataFrame, size: float) -> DataFrame:
    """Voxel occupancy as points come in, in update mode."""
    return points.groupBy("scene", *[voxel_floor(F.col(c), size).alias(f"v{c}") for c in "xyz"]).agg(F.count(F.lit(1)).alias("hits"), F.least(F.lit(1.0), 0.6 + 0.1 * F.count(F.lit(1))).alias("occupancy"), F.min("frame_order").alias("first_frame"), F.max("frame_order").alias("last_frame"))


def _history(n: int, summary: Callable[[np.ndarray], float]):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for rows in batches:
            rows = rows.sort_values("ord")
            kept = (kept + rows["value"].dropna().tolist())[-n:]
        state.update((kept,))
        yield pd.DataFrame({"key": [key[0]], "value": [summary(np.array(kept)) if kept else None], "n": [len(kept)]})

    return run


def stream_last_median(values: DataFrame, n: int = 10) -> DataFrame:
    """values: key, ord, value. The median of each key's last n values (a scale's bounded history)."""
    return values.groupBy("key").applyInPandasWithState(_history(n, lambda v: float(np.median(v))), "key long, value double, n long", "kept array<double>", "update", GroupStateTimeout.NoTimeout)


def stream_ema(values: DataFrame, alpha: float = 0.3, n: int = 8) -> DataFrame:
    """The exponential mean over a buffer of each key's last n values."""

    def fold(v: np.ndarray) -> float:
        out = v[0]
        for x in v[1:]:
            out = alpha * x + (1 - alpha) * out
        return float(out)

    return values.groupBy("key").applyInPandasWithState(_history(n, fold), "key long, value double, n long", "kept array<double>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension: event-time windows with a watermark; events: ts, event_type, value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: sessions of a user by a gap in event time."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")
