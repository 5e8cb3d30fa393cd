"""Small cases worked out by hand or by brute force."""

from __future__ import annotations

import os
import io
import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loculus.functions import models
from loculus.functions import questions as Q
from loculus.functions.geometry import largest_eigenvalue, mahalanobis, sector
from loculus.functions.names import matches, singulars
from loculus.operators import evolution as E
from loculus.operators.answers import route
from loculus.operators.tracking import Tracks, assign, track
from loculus.operators.voxels import components
from loculus.operators.beliefs import entity_beliefs
from loculus.plans import catalog, process_queries
from loculus.plans.fixtures import ALL_SYNONYMS, cameras, detections
from loculus.sources import clouds, results, settings
from loculus.streaming import stateful
from tests.conftest import SMALL, same_rows


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def test_names(spark):
    cases = [("sofa", "couch", True), ("mat", "automatic door", True), ("washer", "washing machine", False), ("", "bed", True), ("coffee table", "dining table", True), ("bed", "door", False)]
    got = one(spark, *[matches(F.lit(a), F.lit(b)) for a, b, _ in cases])
    assert list(got) == [c for _, _, c in cases]
    assert one(spark, singulars(F.lit("glasses")))[0] == ["glasses", "glasse", "glass"]


def test_questions(spark):
    q = F.lit("If I am standing by the stove and facing the tv, is the sofa to my left, right, or back?")
    assert list(one(spark, *Q.groups(F.lower(q), Q.STANDING, 3))) == ["stove", "tv", "sofa"]
    assert one(spark, Q.frame_spec(F.lit("3, 5-8")))[0] == [3, 5, 6, 7, 8]
    assert list(one(spark, *[Q.answer_letter(F.lit(t)) for t in ("B", "b. left", "The answer is C", "maybe D", "none")])) == ["B", "B", "C", "D", None]
    assert one(spark, Q.relative_accuracy(F.lit(4.2), F.lit(10.0)))[0] == 0.8


def test_scores(spark):
    numeric = ["object_counting"]
    cases = [("object_counting", "4", "4", 1.0), ("object_counting", "x", "4", 0.0), ("object_counting", "", "0", 1.0), ("route_planning", "b. left", "B", 1.0), ("route_planning", "C", "B", 0.0)]
    got = one(spark, *[Q.score(F.lit(t), F.lit(p), F.lit(g), numeric) for t, p, g, _ in cases])
    assert list(got) == [s for *_, s in cases]


def test_geometry(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 3))
    c, d = a @ a.T + np.eye(3), rng.normal(size=3)
    six = [F.lit(float(c[i, j])) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
    got = one(spark, mahalanobis(tuple(F.lit(float(x)) for x in d), six), largest_eigenvalue(six))
    assert got[0] == pytest.approx(np.sqrt(d @ np.linalg.inv(c) @ d)) and got[1] == pytest.approx(np.linalg.eigvalsh(c)[-1])
    zero = (F.lit(0.0), F.lit(0.0))
    assert one(spark, sector(zero, (F.lit(0.0), F.lit(1.0)), (F.lit(1.0), F.lit(0.0)))[0])[0] == "right"


def test_assignment():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (2, 3), (4, 2), (4, 4)):
        cost = rng.random((n, m))
        best = min(sum(cost[i, j] for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), min(n, m)) for cols in [range(min(n, m))]) if n > m else min(sum(cost[i, j] for i, j in enumerate(cols)) for cols in itertools.permutations(range(m), n))
        assert sum(cost[i, j] for i, j in assign(cost)) == pytest.approx(best)


def test_two_chairs_are_two_tracks(spark):
    rows = [(1, "chair", f, k, float(k * 3), 0.0, 0.1 * f, 0.9) for f in range(2) for k in range(2)]
    det = spark.createDataFrame(rows, "scene long, label string, frame_order long, det_ord long, x double, y double, z double, confidence double")
    got = sorted(r["n"] for r in track(det).collect())
    assert got == [2, 2]
    t = Tracks("chair", 1.0, 10)
    t.update(0, np.zeros((1, 3)), np.array([0.9]))
    t.update(11, np.zeros((0, 3)), np.zeros(0))
    assert not t.tracks


def test_route_by_simulation(spark):
    places = {"bed": (0, 0), "door": (0, 4), "sofa": (3, 1), "lamp": (4, 5)}
    ent = spark.createDataFrame([(1, n, k, float(x), 0.0, float(z)) for k, (n, (x, z)) in enumerate(places.items(), 1)], "scene long, label string, entity_ord long, mx double, my double, mz double")
    question = "You are a robot beginning at the bed facing the door. You want to navigate to the lamp. You will perform the following actions: 1. [please fill in] 2. Go forward until the sofa 3. [please fill in] 4. Go forward until the lamp."
    options = ["A. Turn Left, Turn Right", "B. Turn Right, Turn Left", "C. Turn Back, Turn Left"]
    q = spark.createDataFrame([("q", 1, question, options)], "qid string, scene long, question string, options array<string>")

    def walk(turns):
        at, face, score = np.array(places["bed"], float), np.array([0.0, 1.0]), 0.0
        for turn, stop in zip(turns, ("sofa", "lamp")):
            face = {"left": np.array([-face[1], face[0]]), "right": np.array([face[1], -face[0]]), "back": -face}[turn]
            way = np.array(places[stop], float) - at
            dot = face @ way / np.linalg.norm(way)
            score += dot if dot > 0 else -0.5
            face, at = way / np.linalg.norm(way), np.array(places[stop], float)
        return score

    best = max("ABC", key=lambda c: walk({"A": ("left", "right"), "B": ("right", "left"), "C": ("back", "left")}[c]))
    assert route(q, ent).collect()[0]["answer"] == best == "B"


def test_components(spark):
    rows = [(1, x, 0, 0) for x in (-3, -2, -1, 0, 5, 6)] + [(2, 0, 0, 0), (2, 0, 1, 0), (2, 0, 1, 1), (2, 2, 2, 2)]
    v = spark.createDataFrame([(*r, 1.0, 0.0, 0.0) for r in rows], "scene long, vx int, vy int, vz int, r double, g double, b double")
    got = {r["scene"]: r["n"] for r in components(v).groupBy("scene").agg(F.countDistinct("component").alias("n")).collect()}
    assert got == {1: 2, 2: 2}


def test_clouds(spark, tmp_path):
    p = np.array([[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]])
    rgb = np.array([[255, 0, 0], [0, 128, 255]], np.uint8)
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    body = "".join(f"{a[0]} {a[1]} {a[2]} {c[0]} {c[1]} {c[2]}\n" for a, c in zip(p, rgb))
    (tmp_path / "one.ply").write_bytes((head.format("ascii") + body).encode())
    (tmp_path / "two.ply").write_bytes(head.format("binary_little_endian").encode() + b"".join(struct.pack("<fffBBB", *a, *c) for a, c in zip(p, rgb)))
    buffer = io.BytesIO()
    np.savez(buffer, points=p, colors=rgb)
    (tmp_path / "three.npz").write_bytes(buffer.getvalue())
    blob = p.astype("<f4").tobytes()
    doc = json.dumps({"meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": 2, "type": "VEC3"}], "bufferViews": [{"buffer": 0, "byteLength": len(blob)}]}).encode()
    doc += b" " * (-len(doc) % 4)
    (tmp_path / "four.glb").write_bytes(struct.pack("<4sII", b"glTF", 2, 28 + len(doc) + len(blob)) + struct.pack("<I4s", len(doc), b"JSON") + doc + struct.pack("<I4s", len(blob), b"BIN\0") + blob)
    for kind, n in (("ply", 4), ("npz", 2), ("glb", 2)):
        rows = clouds.read_clouds(spark, str(tmp_path), kind).collect()
        assert len(rows) == n and {r["z"] for r in rows} == {2.0, 5.0}
    assert clouds.read_scene(spark, str(tmp_path)).count() == 2


def test_results(spark, tmp_path):
    (tmp_path / "gpu0.log").write_text("x [object_counting] ans=3 gt=4 score=0.5 and V7=0.25\nnothing\n[route_planning] ans=A gt=A score=1.0\n")
    rows = results.read_samples(spark, str(tmp_path)).orderBy("task").collect()
    assert [(r["task"], r["score"], r["v7"]) for r in rows] == [("object_counting", 0.5, 0.25), ("route_planning", 1.0, None)]
    other = tmp_path / "other"
    other.mkdir()
    (other / "detailed_results.json").write_text(json.dumps([{"question_type": "route_planning", "prediction": "B", "ground_truth": "A", "score": 0.0, "vl_score": 1.0}]))
    assert results.read_samples(spark, str(other)).collect()[0]["v7"] == 1.0
    total = results.summarize(results.read_samples(spark, str(tmp_path))).filter("kind IS NULL").collect()[0]
    assert (total["n"], total["score"], total["v7"]) == (2, 0.75, 0.25)


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "a.env").write_text("# no\nexport LOCULUS_A='1'\nLOCULUS_B=2\n")
    monkeypatch.setenv("LOCULUS_B", "kept")
    assert settings.load_env(str(tmp_path / "a.env")) == {"LOCULUS_A": "1"}
    monkeypatch.delenv("LOCULUS_A", raising=False)
    assert settings.split_paths("a:b,c\n d ") == ["a", "b", "c", "d"]
    assert (settings.frame_budget(3000, 30.0), settings.frame_budget(90, 30.0), settings.frame_at(2.5, 10.0, 20)) == (128, 8, 19)


def test_boxes_to_detections(spark):
    boxes = spark.createDataFrame([(1, 0, 0, "Door ", 0.9, 0.0, 0.0, 2.0, 2.0), (1, 0, 0, "##x", 0.9, 0.0, 0.0, 2.0, 2.0)], "scene long, frame_order long, frame_idx long, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    cams = spark.createDataFrame([(1, 0, *[float(v) for v in np.eye(3).ravel()], 0.0, 0.0, 1.0, 2.0, 2.0, 1.0, 1.0, 4, 4, 4, 4)], "scene long, frame_order long, " + ", ".join(f"r{k} double" for k in range(9)) + ", t0 double, t1 double, t2 double, fx double, fy double, cx double, cy double, proc_w int, proc_h int, orig_w int, orig_h int")
    depth = spark.createDataFrame([(1, 0, u, v, 2.0) for u in range(4) for v in range(4)], "scene long, frame_order long, u int, v int, depth double")
    (r,) = models.detections_from_boxes(boxes, cams, depth).collect()
    assert (r["label"], r["x"], r["y"], r["z"], r["width_3d"], r["depth_std"]) == ("door", 0.0, 0.0, 1.0, 2.0, 0.0)


def drain(spark, stream, name, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    from loculus.operators.tracking import track
    from loculus.plans.fixtures import detections
    from tests.conftest import SMALL, same_rows

    det = detections(spark, SMALL).filter("scene <= 2 AND frame_order < 4")
    det.repartition(3).write.parquet(str(tmp_path / "det"))
    det = spark.read.parquet(str(tmp_path / "det"))
    stream = spark.readStream.schema(det.schema).parquet(str(tmp_path / "det"))
    assert track(det).count() > 0
    k = drain(spark, stateful.stream_kalman(stream), "kalman")
    assert k.count() == det.select("scene", "label").distinct().count()
    v = drain(spark, stateful.stream_voxels(stream, 0.5), "voxels")
    assert v.agg(F.sum("hits")).collect()[0][0] == det.count()
    values = stream.select(F.col("scene").alias("key"), F.col("det_ord").alias("ord"), F.col("x").alias("value"))
    assert {r["n"] for r in drain(spark, stateful.stream_last_median(values), "medians").collect()} == {10}
    assert drain(spark, stateful.stream_ema(values), "emas").count() == det.select("scene").distinct().count()


def test_event_windows(spark, tmp_path):
    from tests.conftest import SMALL, same_rows

    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    assert drain(spark, stateful.windowed_counts(stream), "windows", "append").count() > 0
    assert drain(spark, stateful.sessions(stream), "sessions", "append").count() > 0


def test_belief_rounds_by_hand(spark):
    """A sure agreement ends in round 1; two labels seen once keep their frames, so the other ends in round 2 and is voted on."""
    kind = "scene int, label string, frame_order int, frame_idx int, confidence double, depth_std double, position_uncertainty double, x double, y double, z double, width_3d double, height_3d double, depth_value double, det_ord int"
    det = spark.createDataFrame([(1, "bed", 0, 0, 0.9, 0.1, 0.1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1), (1, "lamp", 1, 30, 0.9, 0.1, 0.1, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2)], kind)
    q = spark.createDataFrame([("1-1", 1, ["bed", "lamp"]), ("1-2", 1, ["lamp", "bed"])], "qid string, scene int, names array<string>")
    looks = spark.createDataFrame([("1-1", 0, "C", 0.6), ("1-1", 1, "C", 0.7), ("1-2", 0, "A", 0.4), ("1-2", 1, "B", 0.9), ("1-2", 2, "D", 0.9)], "qid string, round int, answer string, conf double")
    got = {r["qid"]: (r["answer"], r["converged"], r["rounds"]) for r in E.belief_rounds(q, det, looks).collect()}
    assert got == {"1-1": ("C", "global_consensus_confident", 1), "1-2": ("B", "no_new_frames", 1)}  # votes 3 x 0.4 and 2 x 0.9


def test_belief_rounds_of_all_questions(spark):
    """Every question gets its rounds, with the answer it gets in a copy of its scene of its own."""
    _, q = process_queries.triples(spark, SMALL)
    got = {r["qid"]: tuple(r) for r in process_queries.belief_rounds(spark, SMALL).collect()}
    assert set(got) == {r["qid"] for r in q.select("qid").collect()}
    few = q.filter(F.crc32(F.col("qid").cast("binary")) % 20 == 0).checkpoint()
    copies = detections(spark, SMALL).join(few.select("scene", "qid"), "scene").drop("scene").withColumnRenamed("qid", "scene")
    alone = E.belief_rounds(few.select("qid", F.col("qid").alias("scene"), "names"), copies, process_queries.looks(few), 3, ALL_SYNONYMS).collect()
    assert len(alone) > 5 and len({r["rounds"] for r in alone}) > 1
    assert all(got[r["qid"]] == tuple(r) for r in alone)


@pytest.mark.parametrize("name", ["j14_ray_visibility", "j17_occluded", "j18_box_hits", "p22_projection"])
def test_views_of_all_frames(spark, name):
    """Every frame's camera gives rows."""
    assert {r[0] for r in catalog.QUERIES[name](spark, SMALL).select("frame_order").distinct().collect()} == set(range(7))


def test_projection_and_box_hits_of_later_frames(spark):
    """Against plain loops over every camera and entity of two scenes."""
    det = detections(spark, SMALL).filter("scene < 2")
    ent = entity_beliefs(det).toPandas()
    cams = cameras(det).toPandas()
    want, hits = {}, {}
    for c in cams.itertuples():
        here = ent[ent["scene"] == c.scene]
        for e in here.itertuples():
            d = np.array([e.mx - c.cx, e.my - c.cy, e.mz - c.cz])
            n = np.sqrt((d * d).sum())
            if d[2] >= 0 and n >= 0.1:
                want[c.scene, c.frame_order, e.label] = (500 * d[0] / n + 320, 500 * d[1] / n + 240)
            for b in here.itertuples():
                lo = (np.array([b.mx - b.w3 / 2, b.my - b.h3 / 2, b.mz - 0.15]) - [c.cx, c.cy, c.cz]) / d
                hi = (np.array([b.mx + b.w3 / 2, b.my + b.h3 / 2, b.mz + 0.15]) - [c.cx, c.cy, c.cz]) / d
                t0, t1 = np.minimum(lo, hi).max(), np.maximum(lo, hi).min()
                if t0 <= t1 and t1 >= 0:
                    k = c.scene, c.frame_order, e.label
                    hits[k] = min(hits.get(k, np.inf), max(t0, 0.0))
    for r in catalog.QUERIES["p22_projection"](spark, SMALL).filter("scene < 2").collect():
        assert (r["u"], r["v"]) == pytest.approx(want.pop((r["scene"], r["frame_order"], r["label"])), abs=1e-4)
    for r in catalog.QUERIES["j18_box_hits"](spark, SMALL).filter("scene < 2").collect():
        assert r["t"] == pytest.approx(hits.pop((r["scene"], r["frame_order"], r["from_label"])), abs=1e-4)
    assert not want and not hits


def test_labels_by_boxes_of_all_frames(spark):
    """Each thing that a frame's camera sees gets a label from that frame's own boxes."""
    got = {(r["scene"], r["frame"], r["thing"]) for r in catalog.QUERIES["j10_labels_by_boxes"](spark, SMALL).collect()}
    seen = {(r["scene"], r["frame_order"], r["label"]) for r in catalog.QUERIES["p22_projection"](spark, SMALL).collect()}
    assert got == seen and {f for _, f, _ in got} == set(range(7))


def test_frame_batches_and_folders(tmp_path):
    from loculus.sources import settings

    assert list(settings.frame_batches(100, 5, 2)) == [[0, 24], [49, 74], [99]]
    assert list(settings.frame_batches(7, 1)) == [[0]]
    assert settings.newest_run(str(tmp_path)) == str(tmp_path)
    for n, (name, file) in enumerate([("old", "gpu0.log"), ("new", "gpu1/detailed_results.json"), ("other", "notes.txt")]):
        f = tmp_path / name / file
        f.parent.mkdir(parents=True)
        f.write_text("")
        os.utime(tmp_path / name, (1000 + n, 1000 + n))
    assert settings.newest_run(str(tmp_path)) == str(tmp_path / "new")
    assert settings.output_dir(None, 3, "t", "o") == "o/run/gpu3" and settings.output_dir(None, None, "t", "o") == "o/run_t" and settings.output_dir("x", None, "t") == "x"


def test_label_rows_and_names_to_add(spark):
    """A hand-made case: the instance seen most gives the place, of equals the first; three names at most, those of no object left out."""
    from loculus.operators import retrieve

    rows = [("s", "cup", 1, 2, 1.0, 0.6, 5, 9), ("s", "cup", 2, 3, 2.0, 0.8, 2, 7), ("s", "cup", 3, 3, 3.0, 1.0, 4, 8)]
    i = spark.createDataFrame(rows, "scene string, label string, entity_ord int, obs_count int, mx double, existence double, first_seen int, last_seen int").withColumns({c: F.lit(1.0) for c in ("my", "mz", "w3", "h3")})
    r = retrieve.label_rows(i).first()
    assert (r["entity_id"], r["count"], r["mx"], r["first_seen"], r["last_seen"]) == ("entity_cup", 3, 2.0, 2, 9) and r["avg_confidence"] == pytest.approx(0.8)
    replies = spark.createDataFrame([("s", "'Lamp' not found; 'x' not found; 'mug' not found; 'sofa' not found"), ("t", None)], "scene string, text string")
    assert [tuple(x) for x in retrieve.names_to_add(replies, i).collect()] == [("s", "lamp")]
    assert retrieve.of_tasks(i, [], "label").count() == 0
    assert retrieve.label_rows(i.limit(0)).count() == 0
