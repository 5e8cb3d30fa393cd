"""Queries of the filtered and the agent family's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loculus.operators import family_answers as A
from loculus.plans.answer_queries import LAB, questions
from loculus.plans.belief_queries import KAL
from loculus.plans.fixtures import ALL_SYNONYMS, d4, detections, rounded, with_ctes
from loculus.plans.registry import query
from loculus.session import cut


def prepared(spark, d, *types):
    """Questions of some types and the filtered family's entities, which are kept and which the questions are of: the detections are dealt once, and texts of questions are not kept."""
    e = cut(A.filtered(detections(spark, d)))
    return questions(e, *types), e


KEN = [
    *LAB, KAL,
    ("ken", "SELECT kal.*, max_in_frame, 1 / (1 + sigma) AS pc, row_number() OVER (PARTITION BY kal.scene ORDER BY first_ord) AS entity_ord FROM kal JOIN frs USING (scene, label)"),
    ("kfs", "SELECT scene, name, " + ", ".join(f"arg_min({c}, entity_ord) AS {c}" for c in ("mx", "my", "mz", "sigma", "confidence", "max_in_frame", "first_seen", "obs_count")) + " FROM ken JOIN mat USING (label) GROUP BY scene, name"),
    ("kdi", """SELECT scene, k, front, rgt, pos FROM (SELECT *, (tx * fx + tz * fz) / nf / nt AS front, (tx * fz - tz * fx) / nf / nt AS rgt FROM (SELECT *, sqrt(fx * fx + fz * fz) AS nf, sqrt(tx * tx + tz * tz) AS nt FROM
      (SELECT lab.scene, k, f.mx - o.mx AS fx, f.mz - o.mz AS fz, t.mx - o.mx AS tx, t.mz - o.mz AS tz, 1 / (1 + o.sigma + f.sigma + t.sigma) AS pos FROM lab JOIN kfs o ON o.scene = lab.scene AND o.name = lab.label JOIN kfs f ON f.scene = lab.scene AND f.name = lab.l1 JOIN kfs t ON t.scene = lab.scene AND t.name = lab.l2)) WHERE nf >= 1e-6 AND nt >= 1e-6)"""),
]


@query("q_b1_counting", with_ctes(f"SELECT 'count-' || lab.scene || '-' || k AS qid, max_in_frame::VARCHAR AS answer, {d4('confidence')} AS sure FROM lab JOIN kfs ON kfs.scene = lab.scene AND kfs.name = split_part(lab.label, ' ', 1)", *KEN))
def b_counting(spark, d):
    q, e = prepared(spark, d, "object_counting")
    return rounded(A.counting(q.filter(F.col("qid").startswith("count-")), e, ALL_SYNONYMS))


@query("q_b3_room_size", with_ctes("SELECT 'room-' || scene || '-' || entity_ord AS qid, printf('%.1f', area) AS answer FROM ken JOIN (SELECT scene, greatest(8.0, least(80.0, (max(mx) - min(mx) + 1.5) * (max(my) - min(my) + 1.5))) AS area FROM ken GROUP BY scene) USING (scene)", *KEN))
def b_room_size(spark, d):
    q, e = prepared(spark, d, "room_size_estimation")
    return A.room_size(q, e).select("qid", "answer")


@query("q_b4_abs_distance", with_ctes(f"SELECT 'dist-' || lab.scene || '-' || k AS qid, printf('%.1f', sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz))) AS answer, {d4('1 / (1 + a.sigma + b.sigma)')} AS sure FROM lab JOIN kfs a ON a.scene = lab.scene AND a.name = lab.label JOIN kfs b ON b.scene = lab.scene AND b.name = lab.l1", *KEN))
def b_abs_distance(spark, d):
    q, e = prepared(spark, d, "object_abs_distance")
    return rounded(A.abs_distance(q, e, ALL_SYNONYMS).select("qid", "answer", "sure"))


@query("q_b5_direction_medium", with_ctes("SELECT 'medium-' || lab.scene || '-' || lab.k AS qid, CASE WHEN front IS NULL THEN 'A. left' WHEN front < -0.5 THEN 'C. back' WHEN rgt > 0 THEN 'B. right' ELSE 'A. left' END AS answer FROM lab LEFT JOIN kdi ON kdi.scene = lab.scene AND kdi.k = lab.k WHERE l2 IS NOT NULL", *KEN))
def b_direction_medium(spark, d):
    q, e = prepared(spark, d, "object_rel_direction_medium")
    return A.direction(q, e, ALL_SYNONYMS).select("qid", "answer")


@query("q_b5_direction_hard", with_ctes("SELECT 'hard-' || lab.scene || '-' || lab.k AS qid, CASE WHEN front IS NULL THEN 'A. front-left' WHEN front > 0 THEN CASE WHEN rgt > 0 THEN 'B. front-right' ELSE 'A. front-left' END ELSE CASE WHEN rgt > 0 THEN 'D. back-right' ELSE 'C. back-left' END END AS answer FROM lab LEFT JOIN kdi ON kdi.scene = lab.scene AND kdi.k = lab.k WHERE l2 IS NOT NULL", *KEN))
def b_direction_hard(spark, d):
    q, e = prepared(spark, d, "object_rel_direction_hard")
    return A.direction(q, e, ALL_SYNONYMS).select("qid", "answer")


@query("q_c1_counting", with_ctes(f"SELECT 'count-' || scene || '-' || k AS qid, answer, {d4('least(1.0, c + 0.2)')} AS sure FROM (SELECT lab.scene, k, arg_min(max_in_frame, entity_ord)::VARCHAR AS answer, arg_min(confidence, entity_ord) AS c FROM lab JOIN ken ON ken.scene = lab.scene AND contains('how many ' || lab.label || '(s) are in this room?', ken.label) GROUP BY lab.scene, k) UNION ALL SELECT 'none-' || scene || '-' || k, '0', 0.3::DOUBLE FROM lab", *KEN))
def c_counting(spark, d):
    q, e = prepared(spark, d, "object_counting")
    return rounded(A.agent_counting(q, e, ALL_SYNONYMS))


@query("q_c7_order", with_ctes("""SELECT 'order-' || scene || '-' || k AS qid, arg_max(o, (p, -i)) AS answer FROM (SELECT lab.scene, k, v.i, any_value(v.o) AS o, sum(r.p) AS p FROM lab, LATERAL (VALUES (0, 'A. ' || label || ', ' || l1 || ', ' || l2 || ', ' || l3), (1, 'B. ' || l1 || ', ' || label || ', ' || l3 || ', ' || l2), (2, 'C. ' || l3 || ', ' || l2 || ', ' || l1 || ', ' || label), (3, 'D. ' || l2 || ', ' || l3 || ', ' || label || ', ' || l1)) v(i, o)
  JOIN (SELECT scene, label, count(*) OVER (PARTITION BY scene) - row_number() OVER (PARTITION BY scene ORDER BY first_seen, entity_ord) + 1 AS p FROM ken) r ON r.scene = lab.scene AND contains(v.o, r.label) WHERE l3 IS NOT NULL GROUP BY ALL) GROUP BY scene, k""", *KEN))
def c_order(spark, d):
    q, e = prepared(spark, d, "obj_appearance_order")
    return A.agent_order(q, e).select("qid", "answer")


def _rows(name, run):
    query(name)(run)


_rows("q_b2_object_size", lambda spark, d: rounded((lambda p: A.object_size(p[0], p[1], ALL_SYNONYMS))(prepared(spark, d, "object_size_estimation"))))
_rows("q_b5_direction_easy", lambda spark, d: rounded((lambda p: A.direction(p[0], p[1], ALL_SYNONYMS))(prepared(spark, d, "object_rel_direction_easy"))))
_rows("q_b6_rel_distance", lambda spark, d: rounded((lambda p: A.rel_distance(p[0], p[1], ALL_SYNONYMS))(prepared(spark, d, "object_rel_distance"))))
_rows("q_b7_order", lambda spark, d: rounded((lambda p: A.appearance_order(p[0], p[1], ALL_SYNONYMS))(prepared(spark, d, "obj_appearance_order"))))
_rows("q_b8_route", lambda spark, d: rounded((lambda p: A.route(p[0], p[1], ALL_SYNONYMS))(prepared(spark, d, "route_planning"))))
_rows("q_c2_abs_distance", lambda spark, d: rounded((lambda p: A.agent_distance(p[0], p[1]))(prepared(spark, d, "object_abs_distance"))))
_rows("q_c5_direction", lambda spark, d: rounded((lambda p: A.agent_direction(p[0], p[1]))(prepared(spark, d, "object_rel_direction_easy", "object_rel_direction_medium", "object_rel_direction_hard"))))
_rows("q_c6_rel_distance", lambda spark, d: rounded((lambda p: A.agent_rel_distance(p[0], p[1]))(prepared(spark, d, "object_rel_distance"))))
_rows("q_c8_route", lambda spark, d: rounded((lambda p: A.agent_route(p[0], p[1]))(prepared(spark, d, "route_planning"))))


@query("q_d1_direction_probabilities")
def direction_probabilities(spark, d):
    e = A.filtered(detections(spark, d)).select("scene", "entity_ord", "mx", "mz", "sigma")
    at = lambda n, p, *more: e.select("scene", (F.col("entity_ord") - n).alias("k"), F.col("mx").alias(f"{p}x"), F.col("mz").alias(f"{p}z"), *more)
    r = at(0, "o").join(at(1, "f"), ["scene", "k"]).join(at(2, "t", F.col("sigma").alias("spread")), ["scene", "k"])
    return A.direction_probabilities(r.withColumn("id", F.concat_ws("-", "scene", "k")))


@query("q_d2_first_seen", with_ctes("SELECT scene, label, first_seen FROM ken", *KEN))
def first_seen(spark, d):
    return A.filtered(detections(spark, d)).select("scene", "label", "first_seen")
