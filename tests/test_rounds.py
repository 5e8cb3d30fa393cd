"""Rounds of belief: detections are dealt once by scene and kept nowhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from loculus.operators import evolution as E
from loculus.operators.beliefs import entity_beliefs, entity_rounds, noisiest


def detections(spark):
    row = lambda k, label, far: (1, label, k, k * 30, k * 3 + (label == "lamp"), 0.5 + k / 20, 0.3, 0.4 + k / 50, k * far, k % 3 * far, k % 2 * far, 1.0, 1.0)
    rows = [row(k, label, far) for label, far in (("chair", 1.0), ("lamp", 0.01)) for k in range(9)]
    return spark.createDataFrame(rows, "scene long, label string, frame_order int, frame_idx int, det_ord int, confidence double, depth_std double, position_uncertainty double, x double, y double, z double, width_3d double, height_3d double")


def test_rounds_of_entities_are_those_of_what_is_left(spark):
    det, limits = detections(spark), (0.4, 0.3)
    got = {r["label"]: r["rounds"] for r in entity_rounds(det, limits).collect()}
    own = det
    for k in range(3):
        ent = entity_beliefs(own)
        for e in ent.collect():
            assert got[e["label"]][k]["o"] == e["first_ord"] and got[e["label"]][k]["f"] == e["support_frames"] and abs(got[e["label"]][k]["u"] - e["position_uncertainty"]) < 1e-9
        if k < 2:
            own = own.join(noisiest(own, ent, limits[k]).select("label", "det_ord"), ["label", "det_ord"], "left_anti")
    assert own.filter("label = 'chair'").count() == 6 and own.filter("label = 'lamp'").count() == 9


def test_detections_are_not_kept_and_frames_not_sent(spark, monkeypatch):
    det, kept = detections(spark), []
    checkpoint = type(det).checkpoint
    monkeypatch.setattr(type(det), "checkpoint", lambda self, *a: kept.append(self.columns) or checkpoint(self, *a))
    q = spark.createDataFrame([("a", 1, ["chair", "lamp"])], "qid string, scene long, names array<string>")
    looks = spark.createDataFrame([("a", k, a, 0.5) for k, a in enumerate("ABCD")], "qid string, round int, answer string, conf double")
    out = E.belief_rounds(q, det, looks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("det_ord" in c for c in kept) and "hashpartitioning(qid#" in plan and ", frame#" not in plan
    assert out.count() == 1 and out.first()["rounds"] >= 1
