"""Detections that are dealt by scene are neither sent again for tracks nor kept."""

from __future__ import annotations

from tests.conftest import SMALL

from loculus.operators.tracking import track
from loculus.plans import catalog


def test_tracks_stay_in_their_scenes_task(spark):
    rows = [(s, label, f, f * 0.1, 0.0, 0.0, 0.9, f) for s in (1, 2) for label in ("lamp", "bed") for f in range(3)]
    det = spark.createDataFrame(rows, "scene long, label string, frame_order int, x double, y double, z double, confidence double, det_ord int")
    got = track(det.repartition("scene"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1
    assert sorted((r["scene"], r["instance"], r["n"]) for r in got.collect()) == sorted((s, f"{label}_001", 3) for s in (1, 2) for label in ("lamp", "bed"))


def test_a_builds_detections_are_not_kept(spark, monkeypatch):
    kind, kept = type(spark.range(1)), []
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: kept.append(self.columns) or checkpoint(self, *a))
    catalog.QUERIES["r4_tracks"](spark, SMALL)
    assert kept and not any("width_3d" in c for c in kept)
