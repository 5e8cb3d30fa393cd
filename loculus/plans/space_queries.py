"""Queries over relations, voxels and views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loculus.functions.geometry import sector
from loculus.operators import lookup as L
from loculus.operators import relations as R
from loculus.operators import spatial as G
from loculus.operators import visibility as V
from loculus.operators import voxels as X
from loculus.operators.beliefs import entity_beliefs
from loculus.plans.fixtures import cameras, d4, detections, points, rounded, vf, vt, with_ctes
from loculus.plans.registry import query

SIZE = 0.5


def entities(spark, d):
    return entity_beliefs(detections(spark, d))


PRS = "prs", """SELECT a.scene, a.label AS al, b.label AS bl, a.entity_ord AS ao, b.entity_ord AS bo, b.mx - a.mx AS dx, b.my - a.my AS dy, b.mz - a.mz AS dz,
  sqrt((b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz)) AS d FROM ent a JOIN ent b ON a.scene = b.scene AND a.entity_ord < b.entity_ord"""


@query("j3_entity_pairs", with_ctes(f"SELECT scene, al AS a_label, bl AS b_label, {d4('d')} AS distance FROM prs", PRS))
def entity_pairs(spark, d):
    return rounded(L.pairs(entities(spark, d)).select("scene", "a_label", "b_label", "distance"))


@query("j4_relations", with_ctes(f"""SELECT scene, al AS subject, r.relation, bl AS object, {d4('r.distance')} AS distance FROM prs, LATERAL (SELECT CASE WHEN d < 0.5 THEN 'next_to' ELSE 'near' END AS relation, d AS distance WHERE d < 1.0
  UNION ALL SELECT CASE WHEN dy > 0 THEN 'below' ELSE 'above' END, abs(dy) WHERE abs(dy) > 0.3) r WHERE d < 3.0""", PRS))
def relations(spark, d):
    return rounded(R.relations(entities(spark, d)))


GRA = "gra", """SELECT scene, al, bl, round_even(d, 2) AS distance, concat_ws('_', CASE WHEN dy / (d + 1e-8) > 0.5 THEN 'above' WHEN dy / (d + 1e-8) < -0.5 THEN 'below' END,
  CASE WHEN abs(dz) > abs(dx) THEN CASE WHEN dz > 0 THEN 'in_front_of' ELSE 'behind' END ELSE CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END END) AS relation FROM prs WHERE d <= 5.0"""


@query("j5_relation_graph", with_ctes("""SELECT scene, al AS source, bl AS target, relation, count(*) AS n FROM gra GROUP BY ALL UNION ALL SELECT scene, bl, al, CASE WHEN relation = 'behind' THEN 'in_front_of' WHEN starts_with(relation, 'above') THEN 'below' || substr(relation, 6) WHEN starts_with(relation, 'below') THEN 'above' || substr(relation, 6) ELSE relation END AS relation, count(*) FROM (SELECT scene, al, bl, CASE WHEN relation IN ('above_behind', 'below_behind') THEN replace(relation, 'behind', 'in_front_of') ELSE relation END AS relation FROM gra) GROUP BY ALL""", PRS, GRA))
def relation_graph(spark, d):
    return R.relation_counts(entities(spark, d), once=True)


@query("j7_nearby", with_ctes(f"SELECT scene, label, other, {d4('d')} AS distance, row_number() OVER (PARTITION BY scene, label ORDER BY round(d, 9), o) AS rank FROM (SELECT scene, al AS label, bl AS other, d, bo AS o FROM prs WHERE d <= 2.0 UNION ALL SELECT scene, bl, al, d, ao FROM prs WHERE d <= 2.0)", PRS))
def nearby(spark, d):
    return rounded(R.nearby(entities(spark, d), 2.0))


REGIONS = [(f"r{i}{k}", 5.0 * i, 0.0, 5.5 * k, 5.0 * i + 5.0, 3.0, 5.5 * k + 5.5) for i in (0, 1) for k in (0, 1)]


@query("j9_regions", with_ctes("SELECT scene, region, label FROM ent JOIN (VALUES " + ", ".join(str(r) for r in REGIONS) + ") r(region, lx, ly, lz, hx, hy, hz) ON mx BETWEEN lx AND hx AND my BETWEEN ly AND hy AND mz BETWEEN lz AND hz"))
def regions(spark, d):
    r = spark.createDataFrame(REGIONS, "region string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    return R.assign_regions(entities(spark, d), F.broadcast(r))  # four regions


@query("j11_nearest_frame", with_ctes("SELECT scene, label, first_seen, arg_min(f, (abs(f - first_seen), f)) AS frame, min(abs(f - first_seen)) AS gap FROM ent, (VALUES (0), (60), (120), (180)) v(f) GROUP BY ALL"))
def nearest_frame(spark, d):
    ent = entities(spark, d)
    frames = ent.select("scene").distinct().withColumn("frame", F.explode(F.array(*map(F.lit, (0, 60, 120, 180)))))
    return L.nearest_frame(ent, frames)


@query("j20_not_found", with_ctes("SELECT DISTINCT scene, 'zebra' AS name FROM ent"))
def not_found(spark, d):
    ent = entities(spark, d)
    names = ent.select("scene", F.col("label").alias("name")).unionByName(ent.select("scene", F.lit("zebra").alias("name")))
    return L.not_found(names, ent)


@query("j23_of_object", with_ctes("SELECT scene, name, al AS subject, bl AS object FROM (SELECT *, unnest([al, bl]) AS name FROM prs WHERE d < 1.0)", PRS))
def of_object(spark, d):
    """What is near each thing."""
    e = entities(spark, d)
    return R.of_object(R.relations(e).filter("relation IN ('near', 'next_to')"), e.select("scene", F.col("label").alias("name"))).select("scene", "name", "subject", "object")


@query("j25_closer_but_later", with_ctes("SELECT a.scene, a.label AS near, b.label AS far FROM ent a JOIN ent b ON a.scene = b.scene AND a.mz < b.mz - 1.0 AND a.first_seen > b.first_seen + 5"))
def closer_but_later(spark, d):
    return G.later_but_nearer(entities(spark, d))


NBR = "nbr", "SELECT scene, al AS label, bl AS other, bo AS o, d FROM prs UNION ALL SELECT scene, bl, al, ao, d FROM prs"


@query("a28_topology", with_ctes(f"""SELECT ent.scene, ent.label, coalesce(n_pairs, 0) AS n_pairs, {d4('mean_distance')} AS mean_distance, {d4('max_distance')} AS max_distance, nearest, {d4('nearest_distance')} AS nearest_distance
  FROM ent LEFT JOIN (SELECT scene, count(*) AS n_pairs, avg(d) AS mean_distance, max(d) AS max_distance FROM prs GROUP BY scene) p ON p.scene = ent.scene
  LEFT JOIN (SELECT scene, label, arg_min(other, (round(d, 9), o)) AS nearest, min(d) AS nearest_distance FROM nbr GROUP BY ALL) n ON n.scene = ent.scene AND n.label = ent.label""", PRS, NBR))
def topology(spark, d):
    return rounded(R.topology(entities(spark, d)))


@query("e16_spatial_conflicts", with_ctes("SELECT p.scene, al AS a_label, bl AS b_label FROM prs p JOIN ent a ON a.scene = p.scene AND a.label = al JOIN ent b ON b.scene = p.scene AND b.label = bl WHERE d < (least(a.w3, a.h3, 0.3) + least(b.w3, b.h3, 0.3)) / 4", PRS))
def spatial_conflicts(spark, d):
    return R.spatial_conflicts(entities(spark, d))


@query("r8_upsert_remove", with_ctes("SELECT scene, label, obs_count FROM (SELECT scene, label, obs_count + 100 AS obs_count FROM ent WHERE entity_ord <= 3 UNION ALL SELECT scene, label, obs_count FROM ent WHERE entity_ord > 5)"))
def upsert_remove(spark, d):
    ent = entities(spark, d).select("scene", "label", "obs_count", "entity_ord")
    new = ent.filter("entity_ord <= 3").select("scene", "label", F.explode(F.array(F.struct((F.col("obs_count") + 7).alias("n"), F.lit(1).alias("o")), F.struct((F.col("obs_count") + 100).alias("n"), F.lit(2).alias("o")))).alias("s"))
    changed = R.upsert(ent.drop("entity_ord"), new.select("scene", "label", F.col("s.n").alias("obs_count"), F.col("s.o").alias("ord")), ["scene", "label"])
    return R.remove(changed, R.relations(entities(spark, d)), ent.filter("entity_ord IN (4, 5)").select("scene", "label"))[0]


SEC = "sec", "SELECT a.scene, a.entity_ord AS k, b.mx - a.mx AS fx, b.mz - a.mz AS fz, c.mx - a.mx AS tx, c.mz - a.mz AS tz FROM ent a JOIN ent b ON a.scene = b.scene AND b.entity_ord = a.entity_ord + 1 JOIN ent c ON c.scene = a.scene AND c.entity_ord = a.entity_ord + 2"


@query("p26_sectors", with_ctes(f"""SELECT scene, k, {d4('ang')} AS angle, CASE WHEN ang > 157.5 OR ang < -157.5 THEN 'back' WHEN ang < -112.5 THEN 'back-left' WHEN ang < -67.5 THEN 'left' WHEN ang < -22.5 THEN 'front-left' WHEN ang < 22.5 THEN 'front' WHEN ang < 67.5 THEN 'front-right' WHEN ang < 112.5 THEN 'right' WHEN ang < 157.5 THEN 'back-right' ELSE 'unknown' END AS direction
  FROM (SELECT scene, k, degrees(atan2(tx * fz - tz * fx, tx * fx + tz * fz)) AS ang FROM sec)""", SEC))
def sectors(spark, d):
    e = entities(spark, d).select("scene", "entity_ord", "mx", "mz")
    at = lambda n, p: e.select("scene", (F.col("entity_ord") - n).alias("k"), F.col("mx").alias(f"{p}x"), F.col("mz").alias(f"{p}z"))
    r = at(0, "o").join(at(1, "f"), ["scene", "k"]).join(at(2, "t"), ["scene", "k"])
    word, angle, _ = sector((F.col("ox"), F.col("oz")), (F.col("fx"), F.col("fz")), (F.col("tx"), F.col("tz")))
    return rounded(r.select("scene", "k", angle.alias("angle"), word.alias("direction")))


VOX = "vox", f"SELECT scene, {vf('x', SIZE)}::INTEGER AS vx, {vf('y', SIZE)}::INTEGER AS vy, {vf('z', SIZE)}::INTEGER AS vz, count(*) AS hits, least(1.0, 0.6 + 0.1 * count(*)) AS occupancy, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, min(frame_order) AS first_frame, max(frame_order) AS last_frame FROM pts GROUP BY ALL"


@query("a8_voxel_fusion", with_ctes(f"SELECT scene, vx, vy, vz, hits, {d4('occupancy')} AS occupancy, {d4('r')} AS r, {d4('g')} AS g, {d4('b')} AS b, first_frame, last_frame FROM vox", VOX))
def voxel_fusion(spark, d):
    return rounded(X.fuse(points(spark, d), SIZE))


@query("a31_downsample", with_ctes(f"SELECT scene, vx, vy, vz, {d4('ax')} AS x, {d4('ay')} AS y, {d4('az')} AS z, {d4('r')} AS r, {d4('g')} AS g, {d4('b')} AS b FROM vox", VOX))
def downsample(spark, d):
    return rounded(X.downsample(points(spark, d), SIZE))


@query("a30_bounds", with_ctes("SELECT scene, " + ", ".join(f"{d4(f'{f}({c})')} AS {n}_{c}" for c in "xyz" for f, n in (("min", "min"), ("max", "max"), ("avg", "mid"))) + " FROM pts GROUP BY scene"))
def bounds(spark, d):
    return rounded(X.bounds(points(spark, d)))


@query("a32_merge_clouds", with_ctes(f"SELECT scene, vx, vy, vz, {d4('avg(x)')} AS x, {d4('avg(y)')} AS y, {d4('avg(z)')} AS z FROM (SELECT scene, x, y, z, {vf('x', 1.0)}::INTEGER AS vx, {vf('y', 1.0)}::INTEGER AS vy, {vf('z', 1.0)}::INTEGER AS vz FROM (SELECT scene, x, y, z FROM pts UNION ALL SELECT scene, z + 0.25, y + 0.5, -x + 0.75 FROM pts)) GROUP BY ALL"))
def merge_clouds(spark, d):
    p = points(spark, d)
    return rounded(X.merge([(p, [1, 0, 0, 0, 1, 0, 0, 0, 1], [0, 0, 0]), (p, [0, 0, 1, 0, 1, 0, -1, 0, 0], [0.25, 0.5, 0.75])], 1.0).drop("r", "g", "b"))


@query("j8_voxels_near", with_ctes(f"""SELECT scene, label AS place, vx, vy, vz, {d4('d')} AS distance FROM (SELECT v.scene, e.label, vx, vy, vz, sqrt(((vx + 0.5) * 0.5 - mx) * ((vx + 0.5) * 0.5 - mx) + ((vy + 0.5) * 0.5 - my) * ((vy + 0.5) * 0.5 - my) + ((vz + 0.5) * 0.5 - mz) * ((vz + 0.5) * 0.5 - mz)) AS d FROM vox v JOIN ent e ON e.scene = v.scene) WHERE d <= 1.5""", VOX))
def voxels_near(spark, d):
    p = entities(spark, d).select("scene", F.col("label").alias("place"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    return rounded(X.near_place(X.fuse(points(spark, d), SIZE), p, 1.5, SIZE))


BOX = "box", f"""SELECT scene, vx, vy, vz, avg(confidence) AS occupancy, count(*) AS n, coalesce(arg_max(label, det_ord) FILTER (confidence > 0.5), arg_min(label, det_ord)) AS label FROM det,
  LATERAL (SELECT unnest(range({vf('x - width_3d / 2', SIZE)}::BIGINT, {vf('x + width_3d / 2', SIZE)}::BIGINT + 1)) AS vx) a, LATERAL (SELECT unnest(range({vf('y - height_3d / 2', SIZE)}::BIGINT, {vf('y + height_3d / 2', SIZE)}::BIGINT + 1)) AS vy) b,
  LATERAL (SELECT unnest(range({vf('z - 0.3 / 2', SIZE)}::BIGINT, {vf('z + 0.3 / 2', SIZE)}::BIGINT + 1)) AS vz) c GROUP BY ALL"""


@query("a12_box_voxels", with_ctes(f"SELECT scene, vx::INTEGER AS vx, vy::INTEGER AS vy, vz::INTEGER AS vz, n, label, {d4('occupancy')} AS occupancy FROM box", BOX))
def box_voxels(spark, d):
    return rounded(X.fill_boxes(detections(spark, d), SIZE))


@query("a13_areas", with_ctes(f"SELECT scene, {d4('count(*) * 0.125')} AS volume, {d4('count(DISTINCT (vx, vz)) * 0.25')} AS floor_area, {d4('(max(vx) - min(vx) + 1) * 0.5 + 1.0')} AS width, {d4('(max(vy) - min(vy) + 1) * 0.5 + 0.5')} AS height, {d4('(max(vz) - min(vz) + 1) * 0.5 + 1.0')} AS depth FROM box WHERE round(occupancy, 9) >= 0.5 GROUP BY scene", BOX))
def areas(spark, d):
    v = X.fill_boxes(detections(spark, d), SIZE)
    return rounded(X.areas(v.withColumn("occupancy", F.round("occupancy", 9)), SIZE, 0.5))


@query("a12_half_open_boxes")
def half_open_boxes(spark, d):
    return X.half_open_boxes(entities(spark, d), SIZE)


@query("a15_box_area", with_ctes(f"SELECT scene, {d4('(max(mx) - min(mx)) * (max(mz) - min(mz))')} AS area FROM ent GROUP BY scene"))
def box_area(spark, d):
    return rounded(X.box_area(entities(spark, d)))


CMP = [
    VOX, ("num", "SELECT *, (vx + 10000)::BIGINT * 1000000000 + (vy + 10000) * 100000 + vz + 10000 AS id FROM vox"),
    ("fac", """SELECT a.id AS a, b.id AS b, a.scene FROM num a JOIN num b ON a.scene = b.scene AND b.id IN (a.id + 1000000000, a.id + 100000, a.id + 1) WHERE a.r * b.r + a.g * b.g + a.b * b.b >= 0.5 * sqrt(a.r * a.r + a.g * a.g + a.b * a.b) * sqrt(b.r * b.r + b.g * b.g + b.b * b.b)"""),
    ("edg", "SELECT scene, a, b FROM fac UNION ALL SELECT scene, b, a FROM fac"), ("rea", "SELECT scene, id AS k, id AS r FROM num UNION SELECT rea.scene, edg.b, rea.r FROM rea JOIN edg ON edg.scene = rea.scene AND edg.a = rea.k"),
    ("cmp", "SELECT scene, k AS id, min(r) AS least FROM rea GROUP BY scene, k"),
]


@query("e21_components", with_ctes("SELECT n.scene, n.vx, n.vy, n.vz, l.vx || ',' || l.vy || ',' || l.vz AS component FROM num n JOIN cmp ON cmp.scene = n.scene AND cmp.id = n.id JOIN num l ON l.scene = n.scene AND l.id = cmp.least", *CMP, recursive=True))
def voxel_components(spark, d):
    return X.components(X.fuse(points(spark, d), SIZE))


_MID = {c: f"(v{c} + 0.5) * {SIZE}" for c in "xyz"}


@query("a17_component_entities", with_ctes(f"""SELECT scene, component, count(*) AS n_voxels, {", ".join(f"{d4(f'avg({_MID[c]})')} AS m{c}" for c in "xyz")}, {", ".join(f"{d4(f'min({_MID[c]})')} AS lo_{c}" for c in "xyz")}, {", ".join(f"{d4(f'max({_MID[c]})')} AS hi_{c}" for c in "xyz")}, {", ".join(f"{d4(f'avg({c})')} AS {c}" for c in "rgb")}, min(first_frame) AS first_seen, max(last_frame) AS last_seen
  FROM (SELECT n.*, l.vx || ',' || l.vy || ',' || l.vz AS component FROM num n JOIN cmp ON cmp.scene = n.scene AND cmp.id = n.id JOIN num l ON l.scene = n.scene AND l.id = cmp.least) GROUP BY scene, component HAVING count(*) >= 10""", *CMP, recursive=True))
def component_entities(spark, d):
    v = X.fuse(points(spark, d), SIZE)
    return rounded(X.component_entities(v, X.components(v), SIZE))


def views(spark, d):
    det = detections(spark, d)
    cam = cameras(det).withColumns({"fx": F.lit(0.0), "fy": F.lit(0.0), "fz": F.lit(1.0)})
    return det, cam, entity_beliefs(det)


SEE = "see", "SELECT c.scene, frame_order, label, cx, cy, cz, mx, my, mz, w3, h3, sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy) + (mz - cz) * (mz - cz)) AS d, mz - cz AS ahead FROM cam c JOIN ent e ON e.scene = c.scene"


@query("j12_trajectory_view", with_ctes("SELECT scene, frame_order, label FROM see WHERE d < 10 AND ahead / d > 0.3", SEE))
def trajectory_view(spark, d):
    _, cam, ent = views(spark, d)
    return V.trajectory_view(cam, ent)


@query("j13_field_of_view", with_ctes(f"SELECT scene, frame_order, label, CASE WHEN d > 10 THEN 'too_far' WHEN d > 1e-6 AND ahead / d < {math.cos(math.radians(75.0))!r}::DOUBLE THEN 'out_of_fov' ELSE 'visible' END AS reason FROM see", SEE))
def field_of_view(spark, d):
    _, cam, ent = views(spark, d)
    return V.field_of_view(cam, ent)


RAY = "ray", "SELECT scene, frame_order, label, cx, cy, cz, mx, my, mz, d, i, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM (SELECT see.*, t.i, mx + t.a * w3 / 2 * 0.8 - cx AS dx, my + t.b * h3 / 2 * 0.8 - cy AS dy, mz + t.c * 0.3 / 2 * 0.8 - cz AS dz FROM see, (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(V.targets(9))) + ") t(i, a, b, c) WHERE d <= 15)"
BLK = "blk", f"SELECT scene, frame_order, label, count(DISTINCT i) AS n FROM (SELECT s.scene, frame_order, label, i, mx, my, mz, s.vx, s.vy, s.vz FROM (SELECT *, {vt('cx + dx / len * (k * 0.25)', 0.5)}::INTEGER AS vx, {vt('cy + dy / len * (k * 0.25)', 0.5)}::INTEGER AS vy, {vt('cz + dz / len * (k * 0.25)', 0.5)}::INTEGER AS vz FROM (SELECT *, unnest(range(1, 1 + greatest(0, least(trunc(len / 0.25)::BIGINT - 1, floor(d * 0.85 / 0.25)::BIGINT)))) AS k FROM ray)) s JOIN vox v USING (scene, vx, vy, vz)) WHERE sqrt(((vx + 0.5) * 0.5 - mx) * ((vx + 0.5) * 0.5 - mx) + ((vy + 0.5) * 0.5 - my) * ((vy + 0.5) * 0.5 - my) + ((vz + 0.5) * 0.5 - mz) * ((vz + 0.5) * 0.5 - mz)) > 1.5 GROUP BY ALL"


@query("j14_ray_visibility", with_ctes(f"SELECT see.scene, see.frame_order, see.label, {d4('CASE WHEN d > 15 THEN 1.0 ELSE coalesce(n, 0) / 9.0::DOUBLE END')} AS occluded, d <= 15 AND coalesce(n, 0) / 9.0::DOUBLE < 0.5 AS visible FROM see LEFT JOIN blk ON blk.scene = see.scene AND blk.frame_order = see.frame_order AND blk.label = see.label", SEE, VOX, RAY, BLK))
def ray_visibility(spark, d):
    _, cam, ent = views(spark, d)
    return rounded(V.ray_visibility(cam, ent, X.fuse(points(spark, d), SIZE), SIZE))


HIT = "hit", f"SELECT r.scene, r.frame_order, r.label, arg_min(b.label, k) AS hit_label, min(k) * 0.25 AS t, any_value(d) AS d FROM (SELECT *, unnest(range(0, ceil((d - 0.1) / 0.25)::BIGINT)) AS k FROM see WHERE d >= 0.1) r JOIN box b ON b.scene = r.scene AND b.vx = {vf('cx + (mx - cx) / (d + 1e-8) * k * 0.25', 0.5)} AND b.vy = {vf('cy + (my - cy) / (d + 1e-8) * k * 0.25', 0.5)} AND b.vz = {vf('cz + (mz - cz) / (d + 1e-8) * k * 0.25', 0.5)} WHERE round(b.occupancy, 9) > 0.5 GROUP BY r.scene, r.frame_order, r.label"


@query("j17_occluded", with_ctes(f"SELECT scene, frame_order, label, hit_label, {d4('1 - t / d')} AS occlusion FROM hit WHERE hit_label <> label", SEE, BOX, HIT))
def occluded(spark, d):
    det, cam, ent = views(spark, d)
    return rounded(V.occluders(cam, ent, det, SIZE))


@query("j18_box_hits", with_ctes(f"""SELECT scene, frame_order, label AS from_label, arg_min(bl, (round(t, 9), bl)) AS box, {d4('min(t)')} AS t FROM (SELECT s.scene, s.frame_order, s.label, b.label AS bl, greatest(t0, 0) AS t FROM (SELECT *, mx - cx AS dx, my - cy AS dy, mz - cz AS dz FROM see) s JOIN ent b ON b.scene = s.scene,
  LATERAL (SELECT greatest(least((b.mx - b.w3 / 2 - cx) / dx, (b.mx + b.w3 / 2 - cx) / dx), least((b.my - b.h3 / 2 - cy) / dy, (b.my + b.h3 / 2 - cy) / dy), least((b.mz - 0.3 / 2 - cz) / dz, (b.mz + 0.3 / 2 - cz) / dz)) AS t0,
  least(greatest((b.mx - b.w3 / 2 - cx) / dx, (b.mx + b.w3 / 2 - cx) / dx), greatest((b.my - b.h3 / 2 - cy) / dy, (b.my + b.h3 / 2 - cy) / dy), greatest((b.mz - 0.3 / 2 - cz) / dz, (b.mz + 0.3 / 2 - cz) / dz)) AS t1) WHERE t0 <= t1 AND t1 >= 0) GROUP BY scene, frame_order, label""", SEE))
def box_hits(spark, d):
    _, cam, ent = views(spark, d)
    return rounded(V.first_boxes(cam, ent).withColumnRenamed("label", "from_label"))


@query("x18_navigable", with_ctes("SELECT DISTINCT scene, gx, gz FROM (SELECT scene, trunc((vx * 0.5 - x0) / 0.3)::INTEGER + 1 AS gx, trunc((vz * 0.5 - z0) / 0.3)::INTEGER + 1 AS gz FROM box JOIN (SELECT scene, min(x) AS x0, min(z) AS z0 FROM det GROUP BY scene) USING (scene) WHERE occupancy > 0.3) WHERE gx BETWEEN 0 AND 49 AND gz BETWEEN 0 AND 49", BOX))
def navigable(spark, d):
    det = detections(spark, d)
    return X.navigable(X.fill_boxes(det, SIZE), det.groupBy("scene").agg(F.min("x").alias("min_x"), F.min("z").alias("min_z")), SIZE)


@query("x17_letter_map")
def letter_map(spark, d):
    return X.letter_map(X.fill_boxes(detections(spark, d), SIZE))
