"""Queries over entity beliefs and scene scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from loculus.operators import beliefs as B
from loculus.operators import scale as S
from loculus.plans.fixtures import ALL_RANGES, ALL_SIZES, ALL_SYNONYMS, cameras, d4, detections, rounded, with_ctes
from loculus.plans.registry import query


def cols(*names: str) -> str:
    return ", ".join(f"{d4(n)} AS {n}" for n in names)


MOMENTS = ("mx", "my", "mz", *B.COV, "position_uncertainty", "confidence", "depth_std_mean", "w3", "h3")


@query("a1_entity_beliefs", with_ctes(f"SELECT scene, label, entity_id, entity_ord, obs_count, count_in_frame, frames, first_seen, {cols(*MOMENTS)} FROM ent"))
def entity_beliefs(spark, d):
    e = B.entity_beliefs(detections(spark, d)).withColumn("frames", F.array_join(F.col("support_frames").cast("array<string>"), ","))
    return rounded(e.select("scene", "label", "entity_id", "entity_ord", "obs_count", "count_in_frame", "frames", "first_seen", *MOMENTS))


@query("a1_frame_confidences", with_ctes(f"SELECT scene, label, frame_idx, {d4('conf')} AS conf FROM frm"))
def frame_confidences(spark, d):
    e = B.entity_beliefs(detections(spark, d))
    return rounded(e.select("scene", "label", F.explode("frame_confidences").alias("frame_idx", "conf")))


@query("a2_scene_bounds", with_ctes(f"SELECT scene, {cols('lo_x', 'lo_y', 'lo_z', 'hi_x', 'hi_y', 'hi_z', 'raw_mpg')} FROM bnd"))
def scene_bounds(spark, d):
    det = detections(spark, d)
    return rounded(S.scene_bounds(B.entity_beliefs(det), cameras(det)))


def scaled(spark, d):
    det = detections(spark, d)
    ent, cam = B.entity_beliefs(det), cameras(det)
    bounds = S.scene_bounds(ent, cam)
    return det, ent, cam, bounds, S.scene_scale(ent, bounds, ALL_SIZES, ALL_RANGES, ALL_SYNONYMS)


@query("a3_scene_scale", with_ctes(f"SELECT scene, n_cal, n_common, {cols('raw_mpg', 'factor', 'mpg', 'scf')} FROM scl"))
def scene_scale(spark, d):
    return rounded(scaled(spark, d)[-1])


@query("a4_room_area", with_ctes(f"""SELECT scene, {d4("greatest(5.0, least(80.0, (e[1] + 2.0) * (e[2] + 2.0)))")} AS area FROM (SELECT scene, list_reverse_sort([x * scf, y * scf, z * scf]) AS e FROM
  (SELECT scene, {", ".join(f"CASE WHEN count(*) >= 10 THEN quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) ELSE max({c}) - min({c}) END AS {c}" for c in "xyz")} FROM plc GROUP BY scene) JOIN scl USING (scene))"""))
def room_area(spark, d):
    _, ent, cam, _, scale = scaled(spark, d)
    return rounded(S.room_area(ent, cam, scale))


@query("p10_grid_cells", with_ctes("SELECT scene, label, " + ", ".join(f"CAST(trunc(greatest(0.0, least(1.0, (m{c} - lo_{c}) / (hi_{c} - lo_{c} + 1e-6))) * 63 + 1e-9) AS INTEGER) AS g{c}" for c in "xyz") + " FROM ent JOIN bnd USING (scene)"))
def grid_cells(spark, d):
    _, ent, _, bounds, _ = scaled(spark, d)
    return S.grid_cells(ent, bounds)


@query("a5_median_entities", with_ctes(f"""SELECT scene, label, max_in_frame AS max_count, obs_count, first_seen, last_seen, {cols("mx", "my", "mz", "w3", "h3", "confidence")} FROM (SELECT scene, label, median(x) AS mx, median(y) AS my, median(z) AS mz, median(width_3d) AS w3, median(height_3d) AS h3, avg(confidence) AS confidence,
  count(*) AS obs_count, max(frame_idx) AS last_seen FROM det GROUP BY ALL) JOIN frs USING (scene, label)"""))
def median_entities(spark, d):
    return rounded(B.median_entities(detections(spark, d)))


@query("a6_best_size_entities", with_ctes(f"""SELECT scene, label, first_seen, {cols("mx", "my", "mz", "w3", "h3", "confidence")} FROM (SELECT scene, label, median(x) AS mx, median(y) AS my, median(z) AS mz, arg_max(width_3d, (confidence, -det_ord)) AS w3, arg_max(height_3d, (confidence, -det_ord)) AS h3, avg(confidence) AS confidence, min(frame_idx) AS first_seen FROM det GROUP BY ALL)"""))
def best_size_entities(spark, d):
    return rounded(B.best_size_entities(detections(spark, d)))


KAL = "kal", """SELECT scene, label, sum(x / (position_uncertainty * position_uncertainty)) / sum(1 / (position_uncertainty * position_uncertainty)) AS mx, sum(y / (position_uncertainty * position_uncertainty)) / sum(1 / (position_uncertainty * position_uncertainty)) AS my,
  sum(z / (position_uncertainty * position_uncertainty)) / sum(1 / (position_uncertainty * position_uncertainty)) AS mz, sqrt(3 / sum(1 / (position_uncertainty * position_uncertainty))) AS sigma, count(*) AS obs_count, avg(confidence) AS confidence, min(det_ord) AS first_ord, min(frame_idx) AS first_seen, max(frame_idx) AS last_seen FROM det GROUP BY ALL"""


@query("a9_kalman_entities", with_ctes(f"SELECT scene, label, obs_count, first_seen, last_seen, row_number() OVER (PARTITION BY scene ORDER BY first_ord) AS entity_ord, {cols('mx', 'my', 'mz', 'sigma', 'confidence')}, {d4('1 / (1 + sigma)')} AS position_confidence FROM kal", KAL))
def kalman_entities(spark, d):
    return rounded(B.kalman_entities(detections(spark, d)).drop("first_ord"))


@query("a10_smoothed_sizes", with_ctes(f"SELECT scene, label, {d4('w.m')} AS w_mean, {d4('h.m')} AS h_mean, {d4('w.s')} AS w_std, {d4('h.s')} AS h_std FROM (SELECT scene, label, "
  + ", ".join(f"list_reduce(l{c}, lambda a, x: {{'m': (a.m * (n - 1) + x.m) / n, 's': sqrt(((n - 1) * a.s * a.s + (x.m - a.m) * (x.m - (a.m * (n - 1) + x.m) / n)) / n)}}) AS {c}" for c in "wh")
  + " FROM (SELECT scene, label, count(*)::DOUBLE AS n, list({'m': width_3d, 's': 0.1::DOUBLE} ORDER BY det_ord) AS lw, list({'m': height_3d, 's': 0.1::DOUBLE} ORDER BY det_ord) AS lh FROM det GROUP BY ALL))"))
def smoothed_sizes(spark, d):
    return rounded(B.smoothed_sizes(detections(spark, d)))


@query("a18_track_moments", with_ctes(f"SELECT scene, label, n, {cols('mx', 'my', 'mz', *B.COV, 'w3', 'h3')}, {d4('cxx + cyy + czz')} AS uncertainty, {d4('least(1.0, 0.5 + 0.1 * n)')} AS existence FROM (SELECT scene, label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, "
  + ", ".join(f"coalesce(covar_samp({a}, {b}), 0){' + 0.01' if a == b else ''} AS c{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")))
  + ", median(width_3d) AS w3, median(height_3d) AS h3, count(*) AS n FROM det GROUP BY ALL)"))
def track_moments(spark, d):
    return rounded(B.track_moments(detections(spark, d)))


NOI = "noi", """SELECT det.scene, det.label, det.det_ord, obs_count, ent.position_uncertainty AS eu, det.position_uncertainty + 0.5 * sqrt(greatest(0, (
  (byy * bzz - cyz * cyz) * dx * dx + (bxx * bzz - cxz * cxz) * dy * dy + (bxx * byy - cxy * cxy) * dz * dz + 2 * ((cxz * cyz - cxy * bzz) * dx * dy + (cxy * cyz - cxz * byy) * dx * dz + (cxy * cxz - bxx * cyz) * dy * dz))
  / (bxx * (byy * bzz - cyz * cyz) - cxy * (cxy * bzz - cyz * cxz) + cxz * (cxy * cyz - byy * cxz)))) + 0.3 * (1 - det.confidence) AS noise
  FROM det JOIN (SELECT *, cxx + 1e-6 AS bxx, cyy + 1e-6 AS byy, czz + 1e-6 AS bzz FROM ent) ent USING (scene, label), LATERAL (SELECT x - mx AS dx, y - my AS dy, z - mz AS dz)"""


@query("p34_noise_scores", with_ctes("SELECT scene, label, det_ord, floor(noise * 100 + 0.50001) / 100 AS noise FROM noi WHERE obs_count >= 5", NOI))
def noise_scores(spark, d):
    det = detections(spark, d)
    return B.noise_scores(det, B.entity_beliefs(det)).filter("obs_count >= 5").select("scene", "label", "det_ord", (F.floor(F.col("noise") * 100 + 0.50001) / 100).alias("noise"))


@query("o4_noisiest_detections", with_ctes("SELECT scene, label, det_ord FROM (SELECT *, row_number() OVER (PARTITION BY scene, label ORDER BY noise DESC, det_ord) AS r FROM noi WHERE obs_count >= 4 AND eu > 0.3) WHERE r <= greatest(1, least(2, obs_count // 4))", NOI))
def noisiest(spark, d):
    det = detections(spark, d)
    return B.noisiest(det, B.entity_beliefs(det), 0.3).select("scene", "label", "det_ord")
