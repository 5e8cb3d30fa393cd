"""Tracks as a stream: the same as in a batch, and ended by timers where nothing comes any more."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loculus.operators.tracking import track
from loculus.plans.fixtures import detections
from loculus.streaming import stateful
from tests.conftest import SMALL

START = dt.datetime(2024, 1, 1)
DET = "scene long, label string, frame_order long, det_ord long, x double, y double, z double, confidence double, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, stateful.ROCKS)
    yield spark
    spark.conf.set(key, was)


def run(spark, path, name, **more):
    """All batches of the files of path, one a batch; returns the result and what the state held after each batch."""
    stream = spark.readStream.schema(DET).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = stateful.stream_tracks(stream, **more).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_same_as_in_a_batch(rocks, tmp_path):
    det = detections(rocks, SMALL).filter("scene <= 2 AND frame_order < 4").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_order")))
    det = det.select("scene", "label", F.col("frame_order").cast("long"), F.col("det_ord").cast("long"), "x", "y", "z", "confidence", "ts")
    for half in (0, 1):  # two batches, the earlier frames first
        det.filter(F.floor(F.col("frame_order") / 2) == half).coalesce(1).write.mode("append").parquet(str(tmp_path / "det"))
    got, _ = run(rocks, tmp_path / "det", "tracks", idle="1 hour")
    last = got.groupBy("scene", "label", "instance").agg(F.max_by(F.struct("n", F.round("mx", 6).alias("mx"), "first_seen", "last_seen"), "n").alias("t"))
    want = track(det).select("scene", "label", "instance", F.struct("n", F.round("mx", 6).alias("mx"), "first_seen", "last_seen").alias("t"))
    assert got.filter("ended").count() == 0
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect()))


def test_silent_tracks_end_by_a_timer(rocks, tmp_path):
    """Scene 1 falls silent: its confirmed track is returned as ended, its lone detection is forgotten, and the state shrinks; scene 2 goes on."""
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, "bed", 0, 1, 0.0, 0.0, 0.0, 0.9, at(0)), (1, "bed", 1, 2, 0.1, 0.0, 0.0, 0.7, at(1)), (1, "lamp", 1, 3, 5.0, 0.0, 0.0, 0.8, at(1)), (2, "bed", 0, 4, 0.0, 0.0, 0.0, 0.9, at(1))],
        [(2, "bed", k, 10 + k, 0.0, 0.0, 0.0, 0.9, at(60 * k)) for k in (1, 2)],
        [(2, "bed", 3, 20, 0.0, 0.0, 0.0, 0.9, at(200))],
        [(2, "bed", 4, 21, 0.0, 0.0, 0.0, 0.9, at(260))],
    ]
    for rows in batches:
        rocks.createDataFrame(rows, DET).coalesce(1).write.mode("append").parquet(str(tmp_path / "det"))
    got, held = run(rocks, tmp_path / "det", "silent", idle="90 seconds", late="5 seconds")
    ended = [(r["scene"], r["label"], r["instance"], r["n"], round(r["mx"], 3), round(r["confidence"], 3)) for r in got.filter("ended").collect()]
    assert ended == [(1, "bed", "bed_001", 2, 0.05, 0.8)]
    assert got.filter("scene = 2").agg(F.max("n")).first()[0] == 5
    assert held[-1] < max(held), held


def test_needs_rocks(spark):
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKS:
        with pytest.raises(ValueError, match="RocksDB"):
            stateful.stream_tracks(spark.createDataFrame([], DET))
