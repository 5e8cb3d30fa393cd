"""Queries of whole builds and of the agent's loop, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loculus.functions.geometry import box_volume, camera_center, overlap_probability
from loculus.functions.questions import is_temporal
from loculus.operators import agent as AG
from loculus.operators import builds as B
from loculus.operators import family_answers as A
from loculus.operators.beliefs import entity_beliefs, kalman_entities, smoothed_sizes
from loculus.operators.evolution import agent_rates
from loculus.operators.lookup import pairs
from loculus.operators.maps import poses
from loculus.operators.tracking import track
from loculus.operators.voxels import areas, fill_boxes, half_open_boxes
from loculus.plans.answer_queries import LAB, questions
from loculus.plans.answers_sql import KEN, QST, RAW, SMS
from loculus.plans.fixtures import ALL_SYNONYMS, d4, detections, rounded, vf, vt, with_ctes
from loculus.plans.lookup_queries import KNOWN
from loculus.plans.registry import query
from loculus.session import cut

VOXEL = 0.2


def boxes(spark, d):
    """Boxes in pixels with raw depths, some of them beyond the image; and each frame's median depth."""
    det = detections(spark, d)
    x, y = F.col("x") * 60 - 20, F.col("y") * 250 - 30
    b = det.select("scene", "frame_order", "frame_idx", "det_ord", "label", "confidence", x.alias("x1"), y.alias("y1"), (x + F.col("width_3d") * 60).alias("x2"), (y + F.col("height_3d") * 60).alias("y2"), F.col("z").alias("depth"), "depth_std")
    return b, det.groupBy("scene", "frame_order").agg(F.median("z").alias("median_depth"))


def path(frames):
    """A camera that turns about the vertical axis by a tenth to and fro and moves on."""
    a, zero, one = (F.col("frame_order") % 3 - 1) / 10.0, F.lit(0.0), F.lit(1.0)
    steps = frames.select("scene", "frame_order", F.array(F.cos(a), zero, F.sin(a), zero, one, zero, -F.sin(a), zero, F.cos(a)).alias("r"), F.array(F.col("frame_order") / 10.0, zero, (F.col("scene") % 4).cast("double")).alias("t"))
    return poses(steps, "scene", ["frame_order"])


def located(spark, d, dynamic, moving, keep=True):
    """Detections of a build; keep: worked out once, for builds whose entities and counts both read them."""
    b, frames = boxes(spark, d)
    frames = cut(frames)
    out = B.locate(b, frames, dynamic, path(frames) if moving else None, KNOWN)
    return cut(out) if keep else out


_KNOWN = "CASE " + " ".join(f"WHEN contains(label, '{n}') THEN {s}::DOUBLE" for n, s in KNOWN) + " END"
BXS = "bxs", """SELECT * FROM (SELECT scene, frame_order, frame_idx, det_ord, lower(label) AS label, confidence, greatest(0, trunc(x * 60 - 20)::INTEGER) AS x1, greatest(0, trunc(y * 250 - 30)::INTEGER) AS y1,
  least(640, trunc(x * 60 - 20 + width_3d * 60)::INTEGER) AS x2, least(480, trunc(y * 250 - 30 + height_3d * 60)::INTEGER) AS y2, z AS depth, depth_std FROM det) WHERE x2 > x1 AND y2 > y1"""
FRD = "frd", "SELECT scene, frame_order, median(z) AS md FROM det GROUP BY ALL"
SCD = "scd", f"""SELECT scene, frame_order, coalesce(m, list_aggregate(h[-10:], 'median'), 2.5 / nullif(md, 0), 1) AS scale FROM (SELECT *, list(m) FILTER (m IS NOT NULL) OVER (PARTITION BY scene ORDER BY frame_order) AS h FROM frd LEFT JOIN
  (SELECT scene, frame_order, median(e) FILTER (e > 0.1 AND e < 10) AS m FROM (SELECT *, CASE WHEN depth > 0 AND (y2 - y1) / 500.0::DOUBLE * depth > 0.01 THEN ({_KNOWN}) / ((y2 - y1) / 500.0::DOUBLE * depth) END AS e FROM bxs) GROUP BY ALL) USING (scene, frame_order))"""
SCU = "scd", "SELECT scene, frame_order, coalesce(2.5 / nullif(md, 0), 1) AS scale FROM frd"
PTH = "pth", """SELECT scene, frame_order, now, 0.1 * sum(cos(before) * tx + sin(before) * tz) OVER w AS px, 0.1 * sum(cos(before) * tz - sin(before) * tx) OVER w AS pz FROM
  (SELECT scene, frame_order, sum(a) OVER v AS now, sum(a) OVER v - a AS before, tx, tz FROM (SELECT scene, frame_order, (frame_order % 3 - 1) / 10.0::DOUBLE AS a, frame_order / 10.0::DOUBLE AS tx, (scene % 4)::DOUBLE AS tz FROM frd) WINDOW v AS (PARTITION BY scene ORDER BY frame_order)) WINDOW w AS (PARTITION BY scene ORDER BY frame_order)"""
_CAM = """SELECT scene, frame_order, frame_idx, det_ord, label, confidence, ((x1 + x2) / 2.0::DOUBLE - 320) / 500 * dep AS a, ((y1 + y2) / 2.0::DOUBLE - 240) / 500 * dep AS b, dep, (x2 - x1) / 500.0::DOUBLE * dep AS w, (y2 - y1) / 500.0::DOUBLE * dep AS h, 0.5::DOUBLE * sd + 0.5::DOUBLE * (1 - confidence) AS u
  FROM (SELECT bxs.*, depth * scale AS dep, depth_std * scale AS sd FROM bxs JOIN scd USING (scene, frame_order))"""
LOC = "loc", f"SELECT *, least(w, h) * 0.5 AS dd FROM (SELECT c.*, cos(now) * a - sin(now) * dep + px AS x, b AS y, sin(now) * a + cos(now) * dep + pz AS z FROM ({_CAM}) c JOIN pth USING (scene, frame_order))"
LCF = "loc", f"SELECT *, least(w, h) * 0.5 AS dd FROM (SELECT c.*, a AS x, b AS y, dep AS z FROM ({_CAM}) c)"
MOST = "mst", "SELECT scene, label, max(n) AS n FROM (SELECT scene, label, frame_idx, count(*) AS n FROM loc GROUP BY ALL) GROUP BY ALL"
MEDIANS = ", ".join(f"{d4(f'median({e})')} AS {n}" for e, n in (("x", "mx"), ("y", "my"), ("z", "mz"), ("w", "w3"), ("h", "h3"), ("dd", "d3"), ("dep", "depth_median")))


def _median(more: tuple, fuzzy: bool) -> str:
    count = "(SELECT a.scene, a.label, max(b.n) AS n FROM mst a JOIN mst b ON a.scene = b.scene AND (contains(a.label, b.label) OR contains(b.label, a.label)) GROUP BY ALL)" if fuzzy else "mst"
    return with_ctes(f"SELECT scene, label, 'entity_' || label AS entity_id, any_value(m.n) AS count, {d4('avg(confidence)')} AS confidence, min(frame_idx) AS first_seen, max(frame_idx) AS last_seen, {MEDIANS} FROM loc JOIN {count} m USING (scene, label) GROUP BY scene, label", BXS, FRD, *more, MOST)


@query("r4_median_build", _median((SCD, PTH, LOC), True))
def r4_median_build(spark, d):
    """Moving camera, scales from known objects, tracker's counts."""
    return rounded(B.median_build(located(spark, d, True, True), tracking=True))


@query("r4_plain_build", _median((SCU, LCF), False))
def r4_plain_build(spark, d):
    """All switches off: the camera's own places under the usual depth."""
    return rounded(B.median_build(located(spark, d, False, False)))


@query("r4_floor_areas", with_ctes(f"""SELECT scene, {d4(f'count(DISTINCT (vx, vz)) * {VOXEL} * {VOXEL}')} AS floor_area, {d4(f'(max(vx) - min(vx) + 1) * {VOXEL} * ((max(vz) - min(vz) + 1) * {VOXEL})')} AS box_area FROM
  (SELECT DISTINCT scene, {vt(f'x - w / 2 + i * {VOXEL}', VOXEL)}::INTEGER AS vx, {vt(f'z - dd / 2 + k * {VOXEL}', VOXEL)}::INTEGER AS vz FROM (SELECT *, unnest(range(ceil(w / {VOXEL})::BIGINT)) AS i FROM loc WHERE h > 0), LATERAL (SELECT unnest(range(ceil(dd / {VOXEL})::BIGINT)) AS k)) GROUP BY scene""", BXS, FRD, SCD, PTH, LOC))
def r4_floor_areas(spark, d):
    """The voxel switch: what the boxes of a build cover of the floor."""
    v = half_open_boxes(B.as_places(located(spark, d, True, True)), VOXEL, F.col("d3"))
    span = lambda c: (F.max(c) - F.min(c) + 1) * VOXEL
    return rounded(v.groupBy("scene").agg((F.countDistinct("vx", "vz") * VOXEL * VOXEL).alias("floor_area"), (span("vx") * span("vz")).alias("box_area")))


@query("r4_tracks")
def r4_tracks(spark, d):
    """The tracking switch: instances of a build, two metres from frame to frame at most, with median places and sizes."""
    return rounded(track(located(spark, d, True, True, keep=False), distance=2.0, median=True))


_SMOOTH = "SELECT scene, label, " + ", ".join(f"list_reduce(l{c}, lambda a, x: {{'m': (a.m * (n - 1) + x.m) / n}}).m AS {c}_mean" for c in "wh") + " FROM (SELECT scene, label, count(*)::DOUBLE AS n, list({'m': w} ORDER BY det_ord) AS lw, list({'m': h} ORDER BY det_ord) AS lh FROM loc GROUP BY ALL)"


@query("r4b_filtered_build", with_ctes(f"""SELECT scene, label, {", ".join(f"{d4(f'sum({c} / (u * u)) / sum(1 / (u * u))')} AS m{c}" for c in "xyz")}, {d4('sqrt(3 / sum(1 / (u * u)))')} AS sigma, count(*) AS obs_count, {d4('avg(confidence)')} AS confidence, min(frame_idx) AS first_seen, max(frame_idx) AS last_seen,
  any_value(mst.n) AS count, {d4('any_value(w_mean)')} AS w_mean, {d4('any_value(h_mean)')} AS h_mean FROM loc JOIN mst USING (scene, label) JOIN ({_SMOOTH}) USING (scene, label) GROUP BY scene, label""", BXS, FRD, SCD, LCF, MOST))
def r4b_filtered_build(spark, d):
    det = located(spark, d, True, False)
    e = kalman_entities(det).join(B.frame_counts(det), ["scene", "label"]).join(smoothed_sizes(det), ["scene", "label"])
    return rounded(e.select("scene", "label", "mx", "my", "mz", "sigma", "obs_count", "confidence", "first_seen", "last_seen", "count", "w_mean", "h_mean"))


@query("r4b_voxel_areas", with_ctes(f"""SELECT scene, {d4(f'count(*) * {VOXEL} * {VOXEL} * {VOXEL}')} AS volume, {d4(f'count(DISTINCT (vx, vz)) * {VOXEL} * {VOXEL}')} AS floor_area FROM (SELECT scene, vx, vy, vz, avg(confidence) AS p FROM loc, LATERAL (SELECT unnest(range({vf('x - w / 2', VOXEL)}::BIGINT, {vf('x + w / 2', VOXEL)}::BIGINT + 1)) AS vx) a,
  LATERAL (SELECT unnest(range({vf('y - h / 2', VOXEL)}::BIGINT, {vf('y + h / 2', VOXEL)}::BIGINT + 1)) AS vy) b, LATERAL (SELECT unnest(range({vf('z - dd / 2', VOXEL)}::BIGINT, {vf('z + dd / 2', VOXEL)}::BIGINT + 1)) AS vz) c GROUP BY ALL) WHERE round(p, 9) >= 0.3 GROUP BY scene""", BXS, FRD, SCU, LCF))
def r4b_voxel_areas(spark, d):
    """The voxels of the same build under the usual depth, as questions of a room's size have it."""
    v = fill_boxes(located(spark, d, False, False), VOXEL, F.col("depth_3d")).withColumn("occupancy", F.round("occupancy", 9))
    return rounded(areas(v, VOXEL, 0.3).select("scene", "volume", "floor_area"))


VIEW = "viw", """SELECT scene, label, frame_order, frame_idx, det_ord, confidence, 0.6 * (a - frame_order / 10.0::DOUBLE) - 0.8 * (z - 1) AS x, b + 0.25 AS y, 0.8 * (a - frame_order / 10.0::DOUBLE) + 0.6 * (z - 1) AS zz, w, h FROM
  (SELECT *, ((x1 + x2) / 2 * 0.5 - 160) / 250 * z AS a, ((y1 + y2) / 2 * 0.5 - 120) / 250 * z AS b, (x2 - x1) * 0.5 * z / 250 AS w, (y2 - y1) * 0.5 * z / 250 AS h FROM (SELECT *, x * 60 - 20 AS x1, x * 60 - 20 + width_3d * 60 AS x2, y * 250 - 30 AS y1, y * 250 - 30 + height_3d * 60 AS y2 FROM det))"""


@query("r4c_view_build", with_ctes(f"""SELECT scene, label, any_value(n) AS count, {d4('median(x)')} AS mx, {d4('median(y)')} AS my, {d4('median(zz)')} AS mz, {d4('arg_max(w, (confidence, -det_ord))')} AS w3, {d4('arg_max(h, (confidence, -det_ord))')} AS h3, 0.3::DOUBLE AS d3, {d4('avg(confidence)')} AS confidence, min(frame_idx) AS first_seen
  FROM viw JOIN (SELECT scene, label, max(n) AS n FROM (SELECT scene, label, frame_idx, count(*) AS n FROM viw GROUP BY ALL) GROUP BY ALL) USING (scene, label) WHERE scene IN (SELECT scene FROM viw GROUP BY scene HAVING max(frame_order) > min(frame_order)) GROUP BY scene, label""", VIEW))
def r4c_view_build(spark, d):
    b, frames = boxes(spark, d)
    lit = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    fixed = {"fx": 250.0, "fy": 250.0, "cx": 160.0, "cy": 120.0, "proc_w": 320.0, "proc_h": 240.0, "orig_w": 640.0, "orig_h": 480.0}
    cams = frames.select("scene", "frame_order", lit(0.6, 0, 0.8, 0, 1, 0, -0.8, 0, 0.6).alias("r"), F.array(F.col("frame_order") / 10.0, F.lit(-0.25), F.lit(1.0)).alias("t"), *[F.lit(v).alias(c) for c, v in fixed.items()])
    return rounded(B.view_build(B.view_detections(b, cams)))


#: Places here are surer than a usual threshold asks for; this one finds some that are not.
THRESHOLD = 0.82
TYPES = ("object_counting", "object_size_estimation", "room_size_estimation", "object_abs_distance", "object_rel_direction_easy", "object_rel_direction_medium", "object_rel_direction_hard", "object_rel_distance", "obj_appearance_order")
_LOOK = "SELECT e.scene, e.label, e.pc < {t} AS low FROM {e} e LEFT JOIN cfl USING (scene, label) WHERE e.pc < {t} OR cfl.label IS NOT NULL"
_NEXT = "SELECT e.* EXCLUDE (sigma, pc, sg), sg AS sigma, 1 / (1 + sg) AS pc FROM (SELECT e.*, sigma * CASE WHEN l.low THEN sqrt({f}::DOUBLE) ELSE 1 END AS sg FROM {e} e LEFT JOIN (SELECT * FROM {l} SEMI JOIN {o} USING (scene)) l USING (scene, label)) e"
LOOP = [
    *[(("ken0", sql) if name == "ken" else (name, sql)) for name, sql in KEN if name not in ("kfs", "kdi")], QST, SMS,
    ("cfl", """SELECT DISTINCT scene, unnest([al, bl]) AS label FROM (SELECT a.scene, a.label AS al, b.label AS bl FROM (SELECT * FROM ken0 JOIN sms USING (scene, label)) a JOIN (SELECT * FROM ken0 JOIN sms USING (scene, label)) b ON a.scene = b.scene AND a.entity_ord < b.entity_ord
      AND sqrt((b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz)) < (least(a.w_mean, a.h_mean, 0.3) + least(b.w_mean, b.h_mean, 0.3)) / 4)"""),
    ("lk1", _LOOK.format(e="ken0", t=THRESHOLD)), ("op1", "SELECT DISTINCT scene FROM ken0"), ("st1", "SELECT scene, bool_or(low) AS cor FROM lk1 GROUP BY scene"), ("k1", _NEXT.format(e="ken0", l="lk1", o="op1", f=1.2)),
    ("lk2", _LOOK.format(e="k1", t=THRESHOLD)), ("op2", "SELECT scene FROM st1 WHERE cor"), ("st2", "SELECT scene, bool_or(low) AS cor FROM lk2 SEMI JOIN op2 USING (scene) GROUP BY scene"), ("ken", _NEXT.format(e="k1", l="lk2", o="op2", f=1.2)),
    ("lk3", _LOOK.format(e="ken", t=THRESHOLD)),
    ("rnd", "SELECT op1.scene, (st1.scene IS NOT NULL)::INTEGER + (st2.scene IS NOT NULL)::INTEGER AS rounds, coalesce(st1.cor, false) OR coalesce(st2.cor, false) AS evolved FROM op1 LEFT JOIN st1 USING (scene) LEFT JOIN st2 USING (scene)"),
]


def _part(name: str) -> str:
    sql, more = RAW[name]
    own = ", ".join(f"{n} AS ({s})" for n, s in more)
    return f"SELECT qid, answer, sure FROM ({f'WITH {own} ' if own else ''}{sql})"


_ROOM = f"SELECT 'room-' || scene || '-' || entity_ord AS qid, CASE WHEN n < 2 THEN (12 + n * 2)::VARCHAR ELSE printf('%.1f', area) END AS answer, {d4('CASE WHEN n < 2 THEN 0.3 ELSE least(1.0, n / 5) END')} AS sure FROM ken JOIN (SELECT scene, count(*) AS n, greatest(8.0, least(80.0, (max(mx) - min(mx) + 1.5) * (max(my) - min(my) + 1.5))) AS area FROM ken GROUP BY scene) USING (scene)"
_COUNT = f"SELECT 'count-' || lab.scene || '-' || k AS qid, arg_min(max_in_frame, entity_ord)::VARCHAR AS answer, {d4('least(1.0, arg_min(confidence, entity_ord) + 0.2)')} AS sure FROM lab JOIN ken ON ken.scene = lab.scene AND contains('how many ' || lab.label || '(s) are in this room?', ken.label) GROUP BY lab.scene, k"
_ORDER = """SELECT 'order-' || scene || '-' || k AS qid, arg_max(o, (p, -i)) AS answer, 0.6::DOUBLE AS sure FROM (SELECT lab.scene, k, v.i, any_value(v.o) AS o, sum(r.p) AS p FROM lab, LATERAL (VALUES (0, 'A. ' || label || ', ' || l1 || ', ' || l2 || ', ' || l3), (1, 'B. ' || l1 || ', ' || label || ', ' || l3 || ', ' || l2), (2, 'C. ' || l3 || ', ' || l2 || ', ' || l1 || ', ' || label), (3, 'D. ' || l2 || ', ' || l3 || ', ' || label || ', ' || l1)) v(i, o)
  JOIN (SELECT scene, label, count(*) OVER (PARTITION BY scene) - row_number() OVER (PARTITION BY scene ORDER BY first_seen, entity_ord) + 1 AS p FROM ken) r ON r.scene = lab.scene AND contains(v.o, r.label) WHERE l3 IS NOT NULL GROUP BY ALL) GROUP BY scene, k"""
_ALL = " UNION ALL ".join([_COUNT, "SELECT 'none-' || scene || '-' || k AS qid, '0' AS answer, 0.3::DOUBLE AS sure FROM lab", _ROOM, _ORDER, *[_part(n) for n in ("q_b2_object_size", "q_c2_abs_distance", "q_c5_direction", "q_c6_rel_distance")]])


@query("e19_agent_loop", with_ctes(f"""SELECT qid, answer, sure, rounds, evolved, CASE WHEN scene IN (SELECT scene FROM lk3) THEN 're_observe' WHEN odd OR coalesce(v > 200 OR (v > 0 AND v < 4), false) THEN 'logic_error' ELSE 'pass' END AS verdict
  FROM (SELECT *, split_part(qid, '-', 2)::BIGINT AS scene, TRY_CAST(answer AS DOUBLE) AS v FROM ({_ALL})) JOIN rnd USING (scene) JOIN (SELECT scene, max(greatest(w_mean, h_mean, 0.3)) > 5 AS odd FROM sms GROUP BY scene) USING (scene)""", *LOOP))
def e19_agent_loop(spark, d):
    """Two rounds at most over all questions, but for routes, which SQL does not answer here."""
    e = cut(A.filtered(detections(spark, d)))
    return rounded(AG.agent_loop(questions(e, *TYPES), e, threshold=THRESHOLD, synonyms=ALL_SYNONYMS))


def _runs(spark, d):
    e = cut(A.filtered(detections(spark, d)))
    return questions(e, "object_size_estimation").join(AG.agent_state(e, threshold=THRESHOLD)[1], "scene")


@query("e20_agent_rates", with_ctes(f"SELECT count(*) AS total, sum(rounds)::BIGINT AS triggered, count(*) FILTER (evolved) AS improved, {d4('sum(rounds) / count(*)')} AS evolution_rate, {d4('count(*) FILTER (evolved) / sum(rounds)')} AS improvement_rate FROM lab JOIN rnd USING (scene)", *LOOP))
def e20_agent_rates(spark, d):
    """Of a question about each entity: how many rounds began, and how many runs they changed."""
    return rounded(agent_rates(_runs(spark, d)))


@query("e18_looked_at", with_ctes(f"SELECT e.scene, e.label, {d4('e.sigma * CASE WHEN e.entity_ord % 3 < 2 AND l.label IS NOT NULL THEN sqrt(0.8::DOUBLE) ELSE 1 END')} AS sigma, l.label IS NOT NULL AS looked_at FROM ken0 e LEFT JOIN lk1 l USING (scene, label)", *LOOP))
def e18_looked_at(spark, d):
    """What looks at doubtful entities do to their spread; replies stand in for a model: they confirm, deny, or say nothing of the thing."""
    e = cut(A.filtered(detections(spark, d)))
    k = F.col("entity_ord") % 3
    replies = e.select("scene", "label", F.when(k == 0, F.concat(F.lit("Yes, there is a "), "label")).when(k == 1, F.concat(F.lit("This is not a "), "label")).otherwise("I can see nothing here.").alias("text"))
    conflicts = cut(AG.in_conflict(e))
    after, _ = AG.agent_state(e, threshold=THRESHOLD, replies=replies, conflicts=conflicts)
    looked = AG.doubtful(e, THRESHOLD, conflicts).select("scene", "label", F.lit(True).alias("l"))
    return rounded(after.join(looked, ["scene", "label"], "left").select("scene", "label", "sigma", F.coalesce("l", F.lit(False)).alias("looked_at")))


@query("p29_overlaps", with_ctes(f"""SELECT scene, al AS a_label, bl AS b_label, {d4('CASE WHEN sa + sb < 1e-6 THEN CASE WHEN d < 0.1 THEN 1.0 ELSE 0.0 END ELSE exp(-d / (sa + sb)) END')} AS overlap FROM
  (SELECT a.scene, a.label AS al, b.label AS bl, a.sigma AS sa, b.sigma AS sb, sqrt((b.mx - a.mx) * (b.mx - a.mx) + (b.my - a.my) * (b.my - a.my) + (b.mz - a.mz) * (b.mz - a.mz)) AS d FROM ken a JOIN ken b ON a.scene = b.scene AND a.entity_ord < b.entity_ord) WHERE d < 1.0""", *KEN))
def p29_overlaps(spark, d):
    """How likely neighbours are one thing, by their distance and spreads."""
    e = cut(A.filtered(detections(spark, d)))
    s = lambda p: e.select("scene", F.col("label").alias(f"{p}_label"), F.col("sigma").alias(f"s{p}"))
    near = pairs(e, 1.0).filter(F.col("distance") < 1.0).join(s("a"), ["scene", "a_label"]).join(s("b"), ["scene", "b_label"])
    return rounded(near.select("scene", "a_label", "b_label", overlap_probability(F.col("distance"), F.col("sa"), F.col("sb")).alias("overlap")))


@query("p2_camera_centers", with_ctes(f"SELECT scene, frame_order, {d4('-(cos(a) * tx - sin(a) * tz)')} AS x, {d4('-0.5::DOUBLE')} AS y, {d4('-(sin(a) * tx + cos(a) * tz)')} AS z FROM (SELECT scene, frame_order, (frame_order % 3 - 1) / 10.0::DOUBLE AS a, md AS tx, (scene % 4)::DOUBLE AS tz FROM frd)", FRD))
def p2_camera_centers(spark, d):
    """Where cameras stand, from turns and shifts that take the world to them."""
    f = boxes(spark, d)[1]
    a, zero, one = (F.col("frame_order") % 3 - 1) / 10.0, F.lit(0.0), F.lit(1.0)
    c = camera_center([F.cos(a), zero, F.sin(a), zero, one, zero, -F.sin(a), zero, F.cos(a)], (F.col("median_depth"), F.lit(0.5), (F.col("scene") % 4).cast("double")))
    return rounded(f.select("scene", "frame_order", *[v.alias(n) for v, n in zip(c, "xyz")]))


@query("p19_box_volumes", with_ctes(f"SELECT scene, label, {d4('w3 * h3 * 0.3')} AS volume, {d4('greatest(w3, h3, 0.3)')} AS longest FROM ent"))
def p19_box_volumes(spark, d):
    e = entity_beliefs(detections(spark, d))
    low, high = (tuple(F.col(f"m{c}") + s * F.col(f"{n}3") / 2 for c, n in zip("xyz", "whd")) for s in (-1, 1))
    return rounded(e.select("scene", "label", box_volume(low, high).alias("volume"), F.greatest("w3", "h3", "d3").alias("longest")))


@query("f11_temporal_questions", with_ctes("SELECT kind || '-' || scene || '-' || k AS qid, kind = 'order' AS temporal FROM qst", *LAB, QST))
def f11_temporal_questions(spark, d):
    """Which questions ask for an order in time."""
    q = questions(cut(entity_beliefs(detections(spark, d))))
    return q.select("qid", is_temporal(F.col("question")).alias("temporal"))
