"""Detections are dealt by scene once; what a scene's groups need later is there already."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from loculus.functions.geometry import opposite_relation, relation_word
from loculus.operators import agent as AG
from loculus.operators import family_answers as A
from loculus.operators import labels as L
from loculus.operators import voxels as X
from loculus.operators.beliefs import entity_beliefs, most_in_frame
from loculus.operators.lookup import first_match, pairs
from loculus.operators.relations import nearby, relation_counts, relation_graph, relations, spatial_conflicts
from loculus.plans.fixtures import detections

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("entities", [entity_beliefs, A.filtered])
def test_entities_deal_detections_once(spark, entities):
    assert exchanges(entities(detections(spark, SF))) == 1


@pytest.mark.parametrize("made", [lambda e: relation_counts(e, once=True), relation_counts, relations, lambda e: nearby(e, 2.0)])
def test_pairs_stay_where_their_scene_is(spark, made):
    assert exchanges(made(entity_beliefs(detections(spark, SF)))) == 1


def test_counts_of_edges_where_labels_are_there_once(spark):
    e = entity_beliefs(detections(spark, SF))
    rows = lambda df: sorted(map(tuple, df.collect()))
    once = rows(relation_counts(e, once=True))
    assert once == rows(relation_counts(e)) and len(once) > 1000


def test_counts_of_edges_where_labels_repeat(spark):
    at = [("rod", 1, 0.0), ("owl", 2, 1.0), ("rod", 3, 0.5), ("owl", 4, 9.0), (None, 5, 2.0)]
    e = spark.createDataFrame([(1, n, k, x, 0.0, 0.0) for n, k, x in at], "scene int, label string, entity_ord int, mx double, my double, mz double")
    found = {(r.source, r.target, r.relation): r.n for r in relation_counts(e).collect()}
    assert found == {
        ("rod", "owl", "right_of"): 1, ("owl", "rod", "right_of"): 1, ("owl", "rod", "left_of"): 1, ("rod", "owl", "left_of"): 1, ("rod", "rod", "right_of"): 2,
        ("rod", None, "right_of"): 2, (None, "rod", "right_of"): 2, ("owl", None, "right_of"): 1, (None, "owl", "right_of"): 1,
    }


def test_words_of_the_way_back(spark):
    at = [(x, y, z) for x in (-1.0, 0.0, 1.0) for y in (-2.0, -0.1, 0.0, 0.1, 2.0) for z in (-1.5, 0.0, 1.0, 1.5)]
    word = lambda **k: relation_word((F.col("x"), F.col("y"), F.col("z")), **k)
    rows = spark.createDataFrame(at, "x double, y double, z double").select(opposite_relation(word()).alias("want"), word(back=True).alias("got")).collect()
    assert all(r.want == r.got for r in rows) and len({r.got for r in rows}) > 6


def test_most_in_frame(spark):
    rows = spark.createDataFrame([(1, [3, 1, 3, 2, 3, 1]), (2, [7]), (3, [])], "k int, f array<int>")
    assert {r.k: r.n for r in rows.select("k", most_in_frame(F.col("f")).alias("n")).collect()} == {1: 3, 2: 1, 3: 0}


def test_first_match_sends_labels_alone(spark):
    names = spark.createDataFrame([(1, "rod"), (1, "red"), (2, "rod"), (2, "owl")], "scene int, name string")
    e = spark.createDataFrame([(1, "red rod", 2, 0.5), (1, "rod", 1, 0.25), (2, "old rod", 3, 1.0)], "scene int, label string, entity_ord int, mx double")
    found = first_match(names, e, ["mx"], {})
    assert sorted((r.scene, r.name, r.e.mx) for r in found.collect()) == [(1, "red", 0.5), (1, "rod", 0.25), (2, "rod", 1.0)]
    grouped = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_min_by" in line]
    assert grouped and not any("mx" in line for line in grouped)


def test_boxes_are_sent_to_slabs_before_they_are_voxels(spark):
    plan = X.fill_boxes(detections(spark, SF), 0.5)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = lambda word: [k for k, line in enumerate(plan) if word in line]
    assert max(at("Generate explode(sequence(z")) < min(at("Exchange hashpartitioning(scene"))


def test_conflicts_are_looked_for_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(AG, "spatial_conflicts", lambda e: calls.append(1) or spatial_conflicts(e))
    e = A.filtered(detections(spark, SF))
    AG.agent_state(e, threshold=0.82)
    assert len(calls) == 1


@pytest.mark.parametrize("most", [0.15, 0.7, 3.0])
def test_pairs_within_a_bound_by_brute_force(spark, most):
    rng = random.Random(7)
    rows = [(s, f"{s}-{k}", k, *[rng.choice((-1, 1)) * rng.randrange(40) * most / 8 for _ in "xyz"]) for s in (1, 2) for k in range(60)]
    e = spark.createDataFrame(rows, "scene int, label string, entity_ord int, mx double, my double, mz double")
    found = sorted((r.a_label, r.b_label) for r in pairs(e, most).filter(F.col("distance") <= most - 1e-9).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and math.dist(a[3:], b[3:]) <= most - 1e-9)
    assert found == want


def test_things_meet_boxes_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 2)
    boxes = spark.createDataFrame([(1, 0, f"b{k}", 0.5 + (k % 3) / 10, 10.0 * k, 0.0, 10.0 * k + 25, 20.0) for k in range(7)], "scene int, frame int, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    things = spark.createDataFrame([(1, 0, "a", 22.0, 5.0), (1, 0, "b", 22.0, 90.0), (1, 0, "c", 900.0, 5.0), (1, 0, "d", None, None), (1, 1, "e", 5.0, 5.0)], "scene int, frame int, thing string, u double, v double")
    out = L.label_by_boxes(things, boxes, 640, 480)
    assert {r.thing: (r.label, round(r.confidence, 6)) for r in out.collect()} == {"a": ("b2", 0.7), "b": ("b1", 0.3), "c": ("object", 0.3), "d": ("unknown", 0.0), "e": ("object", 0.1)}
    assert "partial_max_by" not in out._jdf.queryExecution().executedPlan().toString()
