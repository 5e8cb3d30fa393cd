"""Queries over labels, edits, probes, texts and geometry of single rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loculus.functions import geometry as G
from loculus.functions import texts as T
from loculus.operators import labels as L
from loculus.operators import lookup
from loculus.operators.beliefs import COV, entity_beliefs, track_moments
from loculus.operators.evolution import area_of
from loculus.operators.scale import grid_cells
from loculus.operators.spatial import boxes_that_meet
from loculus.plans.answer_queries import LAB, named, questions
from loculus.plans.belief_queries import cols, scaled
from loculus.plans.fixtures import ALL_SYNONYMS, cameras, d4, detections, read, rounded, vf, vt, with_ctes
from loculus.plans.process_queries import triples
from loculus.plans.registry import query
from loculus.sources import results as Res

# A camera for scalar geometry: a turn about y and a shift.
R, TR = [0.6, 0.0, 0.8, 0.0, 1.0, 0.0, -0.8, 0.0, 0.6], [0.5, -0.25, 1.0]


@query("p1_pixel_to_world", with_ctes(f"SELECT scene, det_ord, {d4('0.6 * (a - 0.5) - 0.8 * (c - 1.0)')} AS wx, {d4('b + 0.25')} AS wy, {d4('0.8 * (a - 0.5) + 0.6 * (c - 1.0)')} AS wz FROM (SELECT scene, det_ord, (x * 40 - 320) / 500 * z AS a, (y * 40 - 240) / 500 * z AS b, z AS c FROM det)"))
def pixel_to_world(spark, d):
    det = detections(spark, d)
    lit = lambda v: [F.lit(float(x)) for x in v]
    w = G.pixel_to_world(F.col("x") * 40, F.col("y") * 40, F.col("z"), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), lit(R), tuple(lit(TR)))
    return rounded(det.select("scene", "det_ord", *[v.alias(f"w{c}") for v, c in zip(w, "xyz")]))


@query("p9_world_to_camera", with_ctes(f"SELECT scene, det_ord, {d4('0.6 * (x - 0.5) + 0.8 * (z - 1.0)')} AS cx, {d4('y + 0.25')} AS cy, {d4('-0.8 * (x - 0.5) + 0.6 * (z - 1.0)')} AS cz FROM det"))
def world_to_camera(spark, d):
    det = detections(spark, d)
    lit = lambda v: [F.lit(float(x)) for x in v]
    c = G.world_to_camera(lit(R), tuple(lit(TR)), (F.col("x"), F.col("y"), F.col("z")))
    return rounded(det.select("scene", "det_ord", *[v.alias(f"c{k}") for v, k in zip(c, "xyz")]))


@query("p12_physical_sizes", with_ctes(f"SELECT scene, label, {d4('greatest(w3, h3) * scf')} AS size, {d4('w3 * h3 * 0.3')} AS volume FROM ent JOIN scl USING (scene)"))
def physical_sizes(spark, d):
    _, ent, _, _, scale = scaled(spark, d)
    return rounded(ent.join(scale, "scene").select("scene", "label", (F.greatest("w3", "h3") * F.col("scf")).alias("size"), (F.col("w3") * F.col("h3") * 0.3).alias("volume")))


@query("p16_voxel_keys", with_ctes(f"SELECT scene, det_ord, {vf('x - 5', 0.5)}::INTEGER AS fx, {vt('x - 5', 0.5)}::INTEGER AS tx FROM det"))
def voxel_keys(spark, d):
    return detections(spark, d).select("scene", "det_ord", G.voxel_floor(F.col("x") - 5, 0.5).alias("fx"), G.voxel_trunc(F.col("x") - 5, 0.5).alias("tx"))


@query("p20_boxes_meet", with_ctes("SELECT a.scene, a.label AS a_label, b.label AS b_label FROM ent a JOIN ent b ON a.scene = b.scene AND a.entity_ord < b.entity_ord AND abs(a.mx - b.mx) <= (a.w3 + b.w3) / 2 AND abs(a.my - b.my) <= (a.h3 + b.h3) / 2 AND abs(a.mz - b.mz) <= 0.3"))
def boxes_meet(spark, d):
    e = entity_beliefs(detections(spark, d))
    ext = {"x": F.col("w3"), "y": F.col("h3"), "z": F.lit(0.3)}
    boxes = e.select("scene", F.col("label").alias("box"), F.col("entity_ord").alias("ord"), *[(F.col(f"m{c}") - ext[c] / 2).alias(f"lo_{c}") for c in "xyz"], *[(F.col(f"m{c}") + ext[c] / 2).alias(f"hi_{c}") for c in "xyz"])
    return boxes_that_meet(boxes).withColumnsRenamed({"a": "a_label", "b": "b_label"})


@query("p22_projection")
def projection(spark, d):
    det = detections(spark, d)
    e = entity_beliefs(det).join(cameras(det), "scene")
    u, v = L.project(tuple(F.col(f"m{c}") for c in "xyz"), tuple(F.col(f"c{c}") for c in "xyz"), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return rounded(e.select("scene", "frame_order", "label", u.alias("u"), v.alias("v")).filter("u IS NOT NULL"))


@query("j10_labels_by_boxes")
def labels_by_boxes(spark, d):
    det = detections(spark, d)
    p = projection(spark, d).select("scene", F.col("frame_order").alias("frame"), F.col("label").alias("thing"), "u", "v")
    boxes = det.select("scene", F.col("frame_order").alias("frame"), "label", "confidence", (F.col("x") * 60).alias("x1"), (F.col("y") * 150).alias("y1"), (F.col("x") * 60 + F.col("width_3d") * 60).alias("x2"), (F.col("y") * 150 + F.col("height_3d") * 60).alias("y2"))
    return rounded(L.label_by_boxes(p, boxes, 640, 480))


@query("p23_quadrants", with_ctes("SELECT scene, k, CASE WHEN tx = 0 AND tz = 0 THEN 'same_position' ELSE CASE WHEN tx * fx + tz * fz >= 0 THEN 'front' ELSE 'behind' END || '-' || CASE WHEN fx * tz - fz * tx >= 0 THEN 'right' ELSE 'left' END END AS word FROM (SELECT scene, k, tx, tz, CASE WHEN dx = 0 AND dz = 0 THEN 0 ELSE dx END AS fx, CASE WHEN dx = 0 AND dz = 0 THEN 1 ELSE dz END AS fz FROM (SELECT a.scene, a.entity_ord AS k, b.gx - a.gx AS dx, b.gz - a.gz AS dz, c.gx - a.gx AS tx, c.gz - a.gz AS tz FROM gce a JOIN gce b ON b.scene = a.scene AND b.entity_ord = a.entity_ord + 1 JOIN gce c ON c.scene = a.scene AND c.entity_ord = a.entity_ord + 2))",
    ("gce", "SELECT scene, entity_ord, " + ", ".join(f"CAST(trunc(greatest(0.0, least(1.0, (m{c} - lo_{c}) / (hi_{c} - lo_{c} + 1e-6))) * 63 + 1e-9) AS INTEGER) AS g{c}" for c in "xz") + " FROM ent JOIN bnd USING (scene)")))
def quadrants(spark, d):
    _, ent, _, bounds, _ = scaled(spark, d)
    g = grid_cells(ent, bounds).join(ent.select("scene", "label", "entity_ord"), ["scene", "label"])
    at = lambda n, p: g.select("scene", (F.col("entity_ord") - n).alias("k"), F.col("gx").cast("double").alias(f"{p}x"), F.col("gz").cast("double").alias(f"{p}z"))
    r = at(0, "o").join(at(1, "f"), ["scene", "k"]).join(at(2, "t"), ["scene", "k"])
    v = lambda p: (F.col(f"{p}x"), F.col(f"{p}z"))
    return r.select("scene", "k", G.quadrant(v("o"), v("f"), v("t")).alias("word"))


@query("p37_size_labels", with_ctes("SELECT scene, label, CASE WHEN h3 > 2 THEN 'tall furniture' WHEN greatest(w3, h3, 0.3) > 1.5 AND least(w3, h3, 0.3) < 0.3 THEN 'table or desk' WHEN w3 * h3 * 0.3 < 0.1 THEN 'small object' WHEN h3 > 0.3 AND h3 < 1 AND w3 * h3 * 0.3 < 0.5 THEN 'chair' ELSE 'furniture' END AS kind FROM ent"))
def size_labels(spark, d):
    return entity_beliefs(detections(spark, d)).select("scene", "label", L.size_label(F.col("w3"), F.col("h3"), F.col("d3")).alias("kind"))


@query("f15_look_again", with_ctes("SELECT scene, label, n FROM (SELECT scene, label, count(*) AS n FROM det GROUP BY ALL) WHERE least(1.0, 0.5 + 0.1 * n) < 0.6 OR n >= 1"))
def look_again(spark, d):
    e = track_moments(detections(spark, d))
    radius = 2.0 * F.sqrt(G.largest_eigenvalue([F.col(c) for c in COV]))
    return e.filter(L.look_again(F.col("existence"), radius, F.lit("abs_distance")) | (radius <= 0.5)).select("scene", "label", "n")


@query("e1_filter_frames", with_ctes(f"SELECT scene, label, obs_count, first_seen, {cols('mx', 'my', 'mz')} FROM (SELECT scene, label, count(*) AS obs_count, min(frame_idx) AS first_seen, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM detw WHERE NOT (frame_order IN (0, 3, 4) AND (scene, label) IN (SELECT fst.scene, arg_min(ent.label, entity_ord) FROM fst JOIN mat ON mat.name = fst.name JOIN ent ON ent.scene = fst.scene AND ent.label = mat.label WHERE fst.name IN ('small', 'old ring') GROUP BY fst.scene, fst.name)) GROUP BY ALL)", *LAB))
def filter_frames(spark, d):
    det = detections(spark, d)
    edits = det.select("scene").distinct().select("scene", F.explode(F.array(F.lit("small"), F.lit("old ring"))).alias("name"), F.lit("0, 3-4").alias("spec"))
    return rounded(L.filter_frames(det, edits, ALL_SYNONYMS).select("scene", "label", "obs_count", "first_seen", "mx", "my", "mz"))


@query("e6_belief_probe", with_ctes(f"SELECT scene || '-' || k AS qid, 'start' AS stage, count(*) AS n_entities, {d4('avg(u)')} AS mean_uncertainty FROM (SELECT lab.scene, k, n.name, arg_min(position_uncertainty, entity_ord) AS u FROM lab, LATERAL (VALUES (label), (l1), (l2)) n(name) JOIN mat ON mat.name = n.name JOIN ent ON ent.scene = lab.scene AND ent.label = mat.label WHERE l2 IS NOT NULL GROUP BY ALL) GROUP BY scene, k", *LAB))
def belief_probe(spark, d):
    ent, q = triples(spark, d)
    return rounded(L.belief_probe(q, ent, "start", ALL_SYNONYMS))


@query("e14_areas", "SELECT e, CASE WHEN e IN ('sink', 'oven') THEN 'kitchen' WHEN e = 'bed' THEN 'bedroom' WHEN e = 'sofa' THEN 'living_room' WHEN e = 'toilet' THEN 'bathroom' END AS area, count(*) AS n FROM (SELECT ['sink', 'oven', 'bed', 'sofa', 'toilet', 'lamp'][event_id % 6 + 1] AS e FROM events) GROUP BY ALL")
def areas(spark, d):
    things = F.array(*map(F.lit, ["sink", "oven", "bed", "sofa", "toilet", "lamp"]))
    e = read(spark, d, "events").select(F.element_at(things, (F.col("event_id") % 6 + 1).cast("int")).alias("e"))
    return e.groupBy("e", area_of(F.col("e")).alias("area")).agg(F.count(F.lit(1)).alias("n"))


@query("a21_counts_by_name", with_ctes("SELECT scene, name, max(max_in_frame) AS most, count(*) AS labels FROM ent JOIN mat USING (label) GROUP BY scene, name", *LAB))
def counts_by_name(spark, d):
    ent = named(spark, d)
    labels = ent.select("label").union(ent.select(F.split_part("label", F.lit(" "), F.lit(1)))).distinct().select(F.col("label").alias("name"))
    names = labels.join(F.broadcast(ent.select("scene").distinct()))  # a word list, once for each scene
    return lookup.all_matches(names, ent, ALL_SYNONYMS).groupBy("scene", "name").agg(F.max("max_in_frame").alias("most"), F.count(F.lit(1)).alias("labels"))


@query("a34b_within", "SELECT event_id, CASE WHEN t = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END WHEN abs(p - t) / abs(t) <= 0.1 THEN 1.0 ELSE 0.0 END AS ok FROM (SELECT event_id, value AS p, (event_id % 50)::DOUBLE AS t FROM events)")
def within(spark, d):
    return read(spark, d, "events").select("event_id", T.within(F.col("value"), (F.col("event_id") % 50).cast("double")).alias("ok"))


@query("a36_exact_match", "SELECT event_id, CASE WHEN event_type = ['click', 'view', 'purchase', 'signup', 'logout'][event_id % 5 + 1] THEN 1.0 ELSE 0.0 END AS ok FROM events")
def exact(spark, d):
    names = F.array(*[F.lit(x) for x in (" Click", "VIEW", "purchase ", "signup", "logout")])
    return read(spark, d, "events").select("event_id", T.exact_match(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")), F.col("event_type")).alias("ok"))


REPLIES = ["B", "answer: c", "The thing\nD. right", "I think it is back", "about 12.5", "no idea"]


@query("x5_clean_answers", "SELECT event_id, ['B', 'C', 'D', 'C', 'A', 'A'][event_id % 6 + 1] AS answer, ['0', '0', '.', '0', '12.5', '0'][event_id % 6 + 1] AS number FROM events")
def clean_answers(spark, d):
    e = read(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("event_id") % 6 + 1).cast("int")).alias("raw"))
    options = F.array(*map(F.lit, ["A. left", "B. right", "C. back"]))
    return e.select("event_id", T.clean_answer(F.col("raw"), options).alias("answer"), T.clean_answer(F.col("raw"), F.lit(None).cast("array<string>")).alias("number"))


@query("x11_missing_names", "SELECT event_id, 'k' || event_id || '|b' AS names FROM events")
def missing_names(spark, d):
    raw = F.concat(F.lit("not found: 'k"), F.col("event_id"), F.lit("' not found, 'b' not found; 'b' not found"))
    return read(spark, d, "events").select("event_id", F.array_join(T.missing_names(raw), "|").alias("names"))


@query("x14_prompts")
def prompts(spark, d):
    q = questions(named(spark, d))
    return q.select("qid", T.prompt(F.col("question"), F.col("options")).alias("prompt"))


@query("s29_grid_text")
def grid_text(spark, d):
    _, ent, _, bounds, scale = scaled(spark, d)
    return Res.grid_text(ent, grid_cells(ent, bounds), scale)


@query("s30_task_text")
def task_text(spark, d):
    e = entity_beliefs(detections(spark, d)).withColumn("line", T.entity_lines(F.lit("object_counting")))
    return e.groupBy("scene").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entity_ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("w14_camera_paths", with_ctes(f"SELECT scene, frame_order, {d4('sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cz - lag(cz) OVER w) * (cz - lag(cz) OVER w))')} AS step FROM cam WINDOW w AS (PARTITION BY scene ORDER BY frame_order)"))
def camera_paths(spark, d):
    w = Window.partitionBy("scene").orderBy("frame_order")
    dx, dz = F.col("cx") - F.lag("cx").over(w), F.col("cz") - F.lag("cz").over(w)
    return rounded(cameras(detections(spark, d)).select("scene", "frame_order", F.sqrt(dx * dx + dz * dz).alias("step")))
