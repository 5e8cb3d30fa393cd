"""Grids, boxes, rays and the index of names against brute force, with ties, borders, nulls and empty tables."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loculus.functions.names import matches
from loculus.functions.tables import SYNONYMS
from loculus.operators import matching as M
from loculus.operators import spatial as S
from loculus.operators.lookup import pairs
from loculus.operators.visibility import seen_pairs
from loculus.operators.voxels import first_hits
from loculus.plans import catalog
from tests.conftest import SMALL, same_rows

ENT = "scene long, label string, entity_ord int, mx double, my double, mz double, first_seen int"


def entity_rows(seed: int = 1):
    """Scenes: a cluster with far outliers, a coarse grid with many ties, all in one place, a line, two, and one alone."""
    rnd = random.Random(seed)
    scenes = [
        [(rnd.gauss(0, 0.1), rnd.gauss(0, 0.1), rnd.gauss(0, 0.1)) for _ in range(60)] + [(500.0, 0.0, 0.0), (0.0, -900.0, 3.0)],
        [(float(rnd.randint(0, 3)), float(rnd.randint(-2, 2)), float(rnd.randint(0, 3))) for _ in range(50)],
        [(1.0, 2.0, 3.0)] * 7,
        [(k * 0.5, 0.0, 0.0) for k in range(40)],
        [(0.0, 0.0, 0.0), (1e6, 0.0, 0.0)],
        [(5.0, 5.0, 5.0)],
    ]
    return [(s, f"e{k}", k + 1, *p, rnd.randint(0, 40)) for s, places in enumerate(scenes) for k, p in enumerate(places)]


def test_nearest_other(spark):
    rows = entity_rows()
    got = {(r["scene"], r["label"]): (r["nearest"], r["nearest_distance"]) for r in S.nearest_other(spark.createDataFrame(rows, ENT).repartition(5)).collect()}
    assert len(got) == len(rows)
    for s, label, _, *p, _ in rows:
        others = [(round(math.dist(p, q), 9), o, other) for s2, other, o, *q, _ in rows if s2 == s and other != label]
        if not others:
            assert got[s, label] == (None, None)
            continue
        best = min(others)
        assert got[s, label][0] == best[2] and got[s, label][1] == pytest.approx(best[0], abs=1e-8)
    assert S.nearest_other(spark.createDataFrame([], ENT)).count() == 0


@pytest.mark.parametrize("most", [0.3, 1.0, 7.0])
def test_pairs_within(spark, most):
    rows = [r for r in entity_rows(2) if r[0] != 4]
    got = pairs(spark.createDataFrame(rows, ENT), most).filter(F.col("distance") < most).select("scene", "a_label", "b_label").collect()
    want = [(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and math.dist(a[3:6], b[3:6]) < most]
    assert sorted(map(tuple, got)) == sorted(want)


def test_later_but_nearer(spark):
    rows = entity_rows(3)
    got = S.later_but_nearer(spark.createDataFrame(rows, ENT)).collect()
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[5] < b[5] - 1.0 and a[6] > b[6] + 5]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def box_rows(seed: int, n: int = 80, coarse: bool = False):
    rnd = random.Random(seed)
    at = (lambda: float(rnd.randint(0, 8))) if coarse else (lambda: rnd.uniform(-10, 10))
    out = []
    for s in range(3):
        for k in range(n):
            low = [at() for _ in range(3)]
            size = [rnd.choice([0.0, 1.0, 2.0]) if coarse else rnd.uniform(0, 1.5) for _ in range(3)]
            out.append((s, f"b{k}", k, *itertools.chain(*[(a, a + b) for a, b in zip(low, size)])))
    out.append((1, "wall", n, -10.0, 10.0, -10.0, 10.0, 9.0, 9.5))
    return out


BOX = "scene int, box string, ord int, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"


@pytest.mark.parametrize("coarse", [False, True])
def test_boxes_that_meet(spark, coarse):
    rows = box_rows(4, coarse=coarse)
    got = S.boxes_that_meet(spark.createDataFrame(rows, BOX)).collect()
    touch = lambda a, b: all(a[k] <= b[k + 1] and a[k + 1] >= b[k] for k in (3, 5, 7))
    assert sorted(map(tuple, got)) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and touch(a, b))


def first_box(ray, boxes):
    (_, s, *v), best = ray, None
    for b in boxes:
        if b[0] != s:
            continue
        t0, t1 = -1e308, 1e308
        for k in range(3):
            o, d, low, high = v[k], v[3 + k], b[3 + 2 * k], b[4 + 2 * k]
            if d == 0:
                t0, t1 = (t0, t1) if low <= o <= high else (1e308, -1e308)
            else:
                t0, t1 = max(t0, min((low - o) / d, (high - o) / d)), min(t1, max((low - o) / d, (high - o) / d))
        if t0 <= t1 and t1 >= 0:
            best = min(best or (9e307, ""), (round(max(t0, 0.0), 9), b[1]))
    return best


@pytest.mark.parametrize("coarse", [False, True])
def test_box_hits(spark, coarse):
    """Rays in all directions, along axes, along borders of cells, from inside and outside, and one without a direction."""
    rnd, boxes = random.Random(5), box_rows(6, coarse=coarse)
    rays = []
    for k in range(300):
        o = [float(rnd.randint(-2, 9)) if coarse else rnd.uniform(-15, 15) for _ in range(3)]
        d = rnd.choice([[rnd.uniform(-1, 1) for _ in range(3)], rnd.choice([[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, 0.0], [-1.0, 1.0, 1.0]])])
        rays.append((f"r{k}", k % 3, *o, *d))
    rays += [("still", 0, *[b + 0.0 for b in boxes[0][3:9:2]], 0.0, 0.0, 0.0), ("no boxes", 9, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rays, "ray string, scene int, ox double, oy double, oz double, dx double, dy double, dz double"), spark.createDataFrame(boxes, BOX)
    got = {r["ray"]: (r["t"], r["box"]) for r in S.box_hits(*frame).collect()}
    for ray in rays:
        want = first_box(ray, boxes)
        assert (ray[0] in got) == (want is not None), ray
        if want:
            assert got[ray[0]][0] == pytest.approx(want[0], abs=1e-8) and got[ray[0]][1] == want[1]
    tested = S.ray_candidates(*frame).select("ray", "box").distinct().count()
    assert tested < len(rays) * len(boxes) / 3 / (2 if coarse else 4)


def test_pairs_tested_grow_with_rays(spark):
    """Four times the boxes at the same density: pairs that are tested grow as the way through them, not with the boxes."""
    rnd, tested = random.Random(8), []
    for n, span in ((125, 10.0), (1000, 20.0), (8000, 40.0)):
        boxes = [(0, f"b{k}", k, *itertools.chain(*[(a, a + 0.5) for a in (rnd.uniform(0, span) for _ in range(3))])) for k in range(n)]
        rays = [(f"r{k}", 0, *[rnd.uniform(0, span) for _ in range(3)], *[rnd.uniform(-1, 1) for _ in range(3)]) for k in range(200)]
        frame = spark.createDataFrame(rays, "ray string, scene int, ox double, oy double, oz double, dx double, dy double, dz double"), spark.createDataFrame(boxes, BOX)
        tested.append(S.ray_candidates(*frame).count() / 200)
    assert tested[1] < 3 * tested[0] and tested[2] < 3 * tested[1] and tested[2] < 8000 / 40, tested


NAMES = ["chair", "Chairs", " office chair ", "tv", "TV stand", "sofa", "couch", "", "  ", "a", "ab", "x-y_z", "the chair", "nightstand", "café", "zebra", "ring", "small ring", "o", "-", "refrigerator", None, "chair"]


def test_name_pairs(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    labels = spark.createDataFrame([(n,) for n in ["chair", "armchair", "couch", "sofa", "television", "tv", "Small Ring", "ring-box", "night stand", "b", "", "café table", "fridge", None, "o"]], "label string")
    for synonyms in (SYNONYMS, {"zebra": ["b", "couch"], "tv": ["television"]}):
        want = names.distinct().join(labels.distinct(), matches(F.col("name"), F.col("label"), synonyms))
        got = M.name_pairs(names, labels, synonyms)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert M.name_pairs(names.limit(0), labels).count() == 0


@pytest.mark.parametrize("lower", [False, True])
def test_holding_pairs(spark, lower):
    rnd = random.Random(9)
    texts = sorted({"".join(rnd.choice("abC ") for _ in range(rnd.randint(0, 6))) for _ in range(120)})
    names, labels = spark.createDataFrame([(t,) for t in texts[::2]], "name string"), spark.createDataFrame([(t,) for t in texts[1::2]], "label string")
    of = str.lower if lower else str
    want = [(n, v) for n in texts[::2] for v in texts[1::2] if n.lower() in of(v) or of(v) in n.lower()]
    assert sorted(map(tuple, M.holding_pairs(names, labels, lower).collect())) == sorted(want)


def test_candidates_are_few(spark):
    """Names that share usual letters alone don't meet."""
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2000)]
    wholes, parts = spark.createDataFrame([(w,) for w in words], "whole string"), spark.createDataFrame([(w[2:7],) for w in words], "part string").distinct()
    grams = wholes.select(F.explode(M.grams(F.col("whole"), 3)).alias("gram")).groupBy("gram").count().agg(F.max("count")).first()[0]
    assert grams < 20  # so at most 20 of 2,000 are tested for each
    assert M.holding(wholes, parts).count() >= len(words)


@pytest.mark.parametrize("parts", [3, 16])
@pytest.mark.parametrize("name", ["j17_occluded", "j14_ray_visibility", "j8_voxels_near", "p11_grid_metres"])
def test_cells_do_not_depend_on_the_order_of_sums(spark, duck, name, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        same_rows(catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.SQL[name]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_camera_on_a_border(spark):
    """A camera whose mean place is a border of voxels but for the last bit sees what one on the border sees."""
    cam = lambda x: spark.createDataFrame([(0, 0, x, 1.5, 1.0, 0.0, 0.0, 1.0)], "scene int, frame_order int, cx double, cy double, cz double, fx double, fy double, fz double")
    ent = spark.createDataFrame([(0, "lamp", 5.0, 1.5, 4.0, 0.5, 0.5)], "scene int, label string, mx double, my double, mz double, w3 double, h3 double")
    vox = spark.createDataFrame([(0, 10, 3, 4, 1.0, "box"), (0, 9, 3, 4, 1.0, "other")], "scene int, vx int, vy int, vz int, occupancy double, label string")
    found = []
    for x in (5.0, 5.000000000000001, 4.999999999999999):
        p = seen_pairs(cam(x), ent)
        rays = p.select(F.lit("r").alias("ray"), "scene", F.col("distance").alias("reach"), *[F.col(f"c{c}").alias(f"o{c}") for c in "xyz"], *[((F.col(f"m{c}") - F.col(f"c{c}")) / F.col("distance")).alias(f"d{c}") for c in "xyz"])
        found.append([tuple(r) for r in first_hits(rays, vox, 0.5).collect()])
    assert found[0] == found[1] == found[2] == [("r", 1.0, "box")]
