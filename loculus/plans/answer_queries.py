"""Queries that answer and score questions of every type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions import questions as Q
from loculus.functions.tables import CHOICE_TASKS, NUMERIC_TASKS, TYPICAL_CM
from loculus.operators import answers as A
from loculus.operators import lookup as L
from loculus.operators import scale as S
from loculus.operators.beliefs import entity_beliefs
from loculus.operators.matching import name_pairs
from loculus.plans.fixtures import ALL_RANGES, ALL_SIZES, ALL_SYNONYMS, cameras, d4, detections, rounded, sql_match, with_ctes
from loculus.plans.registry import query
from loculus.session import cut

OPTIONS = {"easy": ["A. left", "B. right"], "medium": ["A. left", "B. right", "C. back"], "hard": ["A. front-left", "B. front-right", "C. back-left", "D. back-right"]}
STAND = "If I am standing by the %s and facing the %s, is the %s to "


def questions(entities: DataFrame, *types: str) -> DataFrame:
    """Questions of every type, or of some, about each entity and those first seen after it."""
    w = Window.partitionBy("scene").orderBy("k")
    lab = entities.select("scene", "label", F.col("entity_ord").alias("k")).select("*", *[F.lead("label", n).over(w).alias(f"l{n}") for n in range(1, 5)])
    number = (1 + (F.col("scene") * 7 + F.col("k")) % 5).cast("string")
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in "ABCD"[:n]]), ((F.col("scene") * 3 + F.col("k")) % n + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    text = lambda f, *c: F.format_string(f, *[F.col(x) for x in c])
    opt = lambda *rows: F.array(*[F.concat(F.lit(f"{x}. "), F.concat_ws(", ", *[F.col(c) for c in r])) for x, r in zip("ABCD", rows)])
    fixed = lambda k: F.array(*map(F.lit, OPTIONS[k]))

    def part(name: str, qtype: str, question, options, truth, need: int = 0) -> DataFrame:
        rows = lab.filter(f"l{need} IS NOT NULL") if need else lab
        return rows.select(F.concat(F.lit(f"{name}-"), "scene", F.lit("-"), "k").alias("qid"), "scene", "k", F.lit(qtype).alias("qtype"), question.alias("question"), options.alias("options"), truth.alias("ground_truth"))

    word = F.when(F.col("k") % 2 == 0, "closest to").otherwise("farthest from")
    parts = [
        ("count", "object_counting", text("How many %s(s) are in this room?", "label"), none, number),
        ("none", "object_counting", text("How many zebras%s are in this room?", "k"), none, number),
        ("size", "object_size_estimation", text("What is the size of the %s?", "label"), none, number),
        ("room", "room_size_estimation", text("What is the size of this room (in square meters)? %s", "label"), none, number),
        ("dist", "object_abs_distance", text("Measuring from the closest point of each object, what is the distance between the %s and the %s (in meters)?", "label", "l1"), none, number, 1),
        ("easy", "object_rel_direction_easy", text(STAND + "the left or the right of the %s?", "label", "l1", "l2", "l1"), fixed("easy"), pick(2), 2),
        ("medium", "object_rel_direction_medium", text(STAND + "my left, right, or back?", "label", "l1", "l2"), fixed("medium"), pick(3), 2),
        ("hard", "object_rel_direction_hard", text(STAND + "my front-left, front-right, back-left, or back-right?", "label", "l1", "l2"), fixed("hard"), pick(4), 2),
        ("rel", "object_rel_distance", F.concat(F.lit("Which of these objects is the "), word, F.lit(" the "), "label", F.lit("?")), opt(["l1"], ["l2"], ["l3"], ["l4"]), pick(4), 4),
        ("order", "obj_appearance_order", text("What will be the first-time appearance order of the following categories in the video: %s, %s, %s, %s?", "l1", "label", "l3", "l2"), opt(["label", "l1", "l2", "l3"], ["l1", "label", "l3", "l2"], ["l3", "l2", "l1", "label"], ["l2", "l3", "label", "l1"]), pick(4), 3),
        ("route", "route_planning", text("You are a robot beginning at the %s facing the %s. You want to navigate to the %s. You will perform the following actions: 1. [please fill in] 2. Go forward until the %s 3. [please fill in] 4. Go forward until the %s.", "label", "l1", "l3", "l2", "l3"), F.array(*[F.lit(x) for x in ("A. Turn Left, Turn Right", "B. Turn Right, Turn Left", "C. Turn Back, Turn Left", "D. Turn Left, Turn Left")]), pick(4), 3),
    ]
    return reduce(DataFrame.unionByName, [part(*p) for p in parts if not types or p[1] in types])


def prepared(spark, d, *types):
    """Entities, cameras, scales and questions (of some types). A plan of answers reads the first three many times, and they are few beside the detections, so
    they are kept; questions are made from a scene's entities where they are answered, so that their texts are neither kept nor sent."""
    det = detections(spark, d)
    ent, cam = cut(entity_beliefs(det)), cut(cameras(det))
    scale = cut(S.scene_scale(ent, S.scene_bounds(ent, cam), ALL_SIZES, ALL_RANGES, ALL_SYNONYMS))
    return ent, cam, scale, questions(ent, *types)


def named(spark, d):
    """Entities alone, kept."""
    return cut(entity_beliefs(detections(spark, d)))


LAB = [
    ("lab", "SELECT scene, label, entity_ord AS k, " + ", ".join(f"lead(label, {n}) OVER (PARTITION BY scene ORDER BY entity_ord) AS l{n}" for n in range(1, 5)) + " FROM ent"),
    ("nms", "SELECT DISTINCT label AS name FROM ent UNION SELECT DISTINCT split_part(label, ' ', 1) FROM ent"),
    ("mat", f"SELECT n.name, l.label FROM nms n JOIN (SELECT DISTINCT label FROM ent) l ON {sql_match('lower(n.name)', 'lower(l.label)')}"),
    ("fst", "SELECT scene, name, arg_min(mx, entity_ord) AS mx, arg_min(my, entity_ord) AS my, arg_min(mz, entity_ord) AS mz, arg_min(first_seen, entity_ord) AS first_seen FROM ent JOIN mat USING (label) GROUP BY scene, name"),
    ("anc", "SELECT lab.scene, k, max(count_in_frame)::VARCHAR AS answer FROM lab JOIN mat ON mat.name = lab.label JOIN ent ON ent.scene = lab.scene AND ent.label = mat.label GROUP BY lab.scene, k"),
    ("ans", "SELECT scene, k, CASE WHEN cm BETWEEN 5 AND 500 THEN cm::VARCHAR ELSE coalesce((SELECT arg_min(v, o)::VARCHAR FROM (VALUES " + ", ".join(f"({o}, '{k}', {v})" for o, (k, v) in enumerate(TYPICAL_CM)) + ") t(o, w, v) WHERE contains(label, w)), '80') END AS answer FROM (SELECT lab.scene, k, any_value(lab.label) AS label, CAST(round_even(arg_max(greatest(w3, h3), (round(confidence, 9), -entity_ord)) * any_value(scf) * 100, 0) AS INTEGER) AS cm FROM lab JOIN mat ON mat.name = lab.label JOIN ent ON ent.scene = lab.scene AND ent.label = mat.label JOIN scl ON scl.scene = lab.scene GROUP BY lab.scene, k)"),
    ("and_", "SELECT lab.scene, k, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz)) * scf AS d FROM lab JOIN fst a ON a.scene = lab.scene AND a.name = lab.label JOIN fst b ON b.scene = lab.scene AND b.name = split_part(lab.l1, ' ', 1) JOIN scl ON scl.scene = lab.scene WHERE l1 IS NOT NULL"),
    ("dir", "SELECT scene, k, CASE WHEN nf >= 1e-8 AND nt >= 1e-8 THEN (tx * fx + tz * fz) / nf END AS ahead, CASE WHEN nf >= 1e-8 AND nt >= 1e-8 THEN (fx * tz - fz * tx) / nf END AS rgt FROM (SELECT *, sqrt(fx * fx + fz * fz) AS nf, sqrt(tx * tx + tz * tz) AS nt FROM (SELECT lab.scene, k, f.mx - o.mx AS fx, f.mz - o.mz AS fz, t.mx - o.mx AS tx, t.mz - o.mz AS tz FROM lab JOIN fst o ON o.scene = lab.scene AND o.name = lab.label JOIN fst f ON f.scene = lab.scene AND f.name = lab.l1 JOIN fst t ON t.scene = lab.scene AND t.name = lab.l2))"),
    ("rld", "SELECT scene, k, coalesce(arg_min(letter, (CASE WHEN k % 2 = 0 THEN d ELSE -d END, letter)), 'A') AS answer FROM (SELECT lab.scene, k, o.letter, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz)) * scf AS d FROM lab, LATERAL (VALUES ('A', l1), ('B', l2), ('C', l3), ('D', l4)) o(letter, name) JOIN fst a ON a.scene = lab.scene AND a.name = lab.label JOIN fst b ON b.scene = lab.scene AND b.name = o.name JOIN scl ON scl.scene = lab.scene WHERE l4 IS NOT NULL) GROUP BY scene, k"),
    ("seq", "SELECT lab.scene, k, any_value(label) AS l0, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3, list(n.name ORDER BY first_seen, n.i) AS s FROM lab, LATERAL (VALUES (0, l1), (1, label), (2, l3), (3, l2)) n(i, name) JOIN fst ON fst.scene = lab.scene AND fst.name = n.name WHERE l3 IS NOT NULL GROUP BY lab.scene, k"),
    ("pos", "SELECT seq.scene, seq.k, o.letter, count(mat.label) AS p FROM seq, LATERAL (VALUES ('A', [l0, l1, l2, l3]), ('B', [l1, l0, l3, l2]), ('C', [l3, l2, l1, l0]), ('D', [l2, l3, l0, l1])) o(letter, items), LATERAL (SELECT unnest([1, 2, 3, 4]) AS i) u LEFT JOIN mat ON mat.name = o.items[u.i] AND mat.label = s[u.i] GROUP BY ALL"),
    ("odr", "SELECT scene, k, arg_max(letter, (p, -ascii(letter))) AS answer FROM pos GROUP BY scene, k"),
]
NUM, PICK = "(1 + (scene * 7 + k) % 5)::VARCHAR", "chr((65 + (scene * 3 + k) % {n})::INTEGER)"
ANSWERS = {
    "q_a1_counting": ("count", "object_counting", "SELECT scene, k, answer FROM anc", NUM),
    "q_a1_not_there": ("none", "object_counting", "SELECT scene, k, '0' AS answer FROM lab", NUM),
    "q_a2_object_size": ("size", "object_size_estimation", "SELECT scene, k, answer FROM ans", NUM),
    "q_a4_abs_distance": ("dist", "object_abs_distance", "SELECT scene, k, printf('%.2f', greatest(0.1, least(d, 20.0))) AS answer FROM and_", NUM),
    "q_a5_direction_easy": ("easy", "object_rel_direction_easy", "SELECT scene, k, CASE WHEN rgt IS NULL OR rgt < 0 THEN 'A' ELSE 'B' END AS answer FROM dir", PICK.format(n=2)),
    "q_a5_direction_medium": ("medium", "object_rel_direction_medium", "SELECT scene, k, CASE WHEN rgt IS NULL THEN 'A' WHEN ahead < 0 THEN 'C' WHEN rgt >= 0 THEN 'B' ELSE 'A' END AS answer FROM dir", PICK.format(n=3)),
    "q_a5_direction_hard": ("hard", "object_rel_direction_hard", "SELECT scene, k, CASE WHEN rgt IS NULL THEN 'A' WHEN ahead >= 0 THEN CASE WHEN rgt >= 0 THEN 'B' ELSE 'A' END ELSE CASE WHEN rgt >= 0 THEN 'D' ELSE 'C' END END AS answer FROM dir", PICK.format(n=4)),
    "q_a6_rel_distance": ("rel", "object_rel_distance", "SELECT scene, k, answer FROM rld", PICK.format(n=4)),
    "q_a7_appearance_order": ("order", "obj_appearance_order", "SELECT scene, k, answer FROM odr", PICK.format(n=4)),
}


def _register(name: str, prefix: str, qtype: str, sql: str, truth: str) -> None:
    numeric = qtype in NUMERIC_TASKS
    scoring = "CASE WHEN g = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_filter(range(10), lambda i: abs(p - g) / (abs(g) + 1e-8) < 1 - (0.05::DOUBLE + i * 0.05::DOUBLE))) / 10.0 END" if numeric else "CASE WHEN answer = t THEN 1.0 ELSE 0.0 END"
    num = ", answer::DOUBLE AS p, t::DOUBLE AS g" if numeric else ""

    @query(name, with_ctes(f"SELECT '{prefix}-' || scene || '-' || k AS qid, scene, answer, {scoring} AS score FROM (SELECT *{num} FROM (SELECT *, {truth} AS t FROM ({sql})))", *LAB))
    def run(spark, d):
        ent, cam, scale, q = prepared(spark, d, qtype)
        q = q.filter(F.col("qid").startswith(prefix + "-"))
        return A.answered(q, ent, scale, ALL_SYNONYMS, qtype).select("qid", "scene", "answer", "score")


for _name, _parts in ANSWERS.items():
    _register(_name, *_parts)


@query("q_a3_room_size", with_ctes(f"""SELECT 'room-' || scene || '-' || entity_ord AS qid, CAST(round_even(area, 0) AS INTEGER)::VARCHAR AS answer FROM ent JOIN (SELECT scene, greatest(5.0, least(80.0, (e[1] + 2.0) * (e[2] + 2.0))) AS area FROM (SELECT scene, list_reverse_sort([x * scf, y * scf, z * scf]) AS e FROM
  (SELECT scene, {", ".join(f"CASE WHEN count(*) >= 10 THEN quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) ELSE max({c}) - min({c}) END AS {c}" for c in "xyz")} FROM plc GROUP BY scene) JOIN scl USING (scene))) USING (scene)"""))
def room_size(spark, d):
    ent, cam, scale, q = prepared(spark, d, "room_size_estimation")
    return A.room_size(q, S.room_area(ent, cam, scale))


@query("q_a8_route")
def route(spark, d):
    ent = named(spark, d)
    return A.route(questions(ent, "route_planning"), ent, ALL_SYNONYMS)


@query("q_a9_all_answers")
def all_answers(spark, d):
    ent, cam, scale, q = prepared(spark, d)
    return A.answer_all(q, ent, cam, scale, S.room_area(ent, cam, scale), ALL_SYNONYMS).select("qid", "qtype", "answer", "ground_truth", "score")


@query("a25_run_summary")
def run_summary(spark, d):
    rows = all_answers(spark, d).withColumn("kind", Q.task_kind(F.col("qtype"), CHOICE_TASKS, NUMERIC_TASKS))
    return rounded(rows.rollup("kind", "qtype").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), (F.avg((F.col("score") >= 1).cast("int")) * 100).alias("percent_full")))


@query("f1_fuzzy_matches", with_ctes("SELECT name, label FROM mat", *LAB))
def fuzzy_matches(spark, d):
    ent = named(spark, d).select("label").distinct()
    names = ent.select(F.col("label").alias("name")).union(ent.select(F.split_part("label", F.lit(" "), F.lit(1)))).distinct()
    return name_pairs(names, ent, ALL_SYNONYMS)


@query("j1_first_match", with_ctes(f"SELECT scene, name, first_seen, {d4('mx')} AS mx FROM fst", *LAB))
def first_match(spark, d):
    ent = named(spark, d)
    one = F.split_part("label", F.lit(" "), F.lit(1))
    labels = ent.select("label").union(ent.select(one)).distinct().select(F.col("label").alias("name"))
    names = labels.join(F.broadcast(ent.select("scene").distinct()))  # a word list, once for each scene
    return rounded(L.first_match(names, ent, ["mx", "first_seen"], ALL_SYNONYMS).select("scene", "name", "e.first_seen", "e.mx"))


@query("x1_question_names", with_ctes("""SELECT 'rel-' || scene || '-' || k AS qid, concat_ws('|', CASE WHEN k % 2 = 0 OR true THEN split_part(label, ' ', 1) END, l1, l2, l3, l4) AS names FROM lab WHERE l4 IS NOT NULL UNION ALL SELECT 'dist-' || scene || '-' || k, label || '|' || split_part(l1, ' ', 1) FROM lab WHERE l1 IS NOT NULL""", *LAB))
def question_names(spark, d):
    q = questions(named(spark, d), "object_rel_distance", "object_abs_distance")
    return q.select("qid", F.array_join(Q.question_names(F.col("question"), F.col("options")), "|").alias("names"))


@query("x2_computation", with_ctes("SELECT v.t AS qtype, v.c AS computation, count(*) AS n FROM lab, (VALUES ('object_counting', 'count', 0), ('object_counting', 'count', 0), ('object_size_estimation', 'size', 0), ('room_size_estimation', 'room_size', 0), ('object_abs_distance', 'distance', 1), ('object_rel_direction_easy', 'direction', 2), ('object_rel_direction_medium', 'direction', 2), ('object_rel_direction_hard', 'direction', 2), ('object_rel_distance', NULL, 4), ('obj_appearance_order', NULL, 3), ('route_planning', 'route', 3)) v(t, c, need) WHERE (need = 0 OR (need = 1 AND l1 IS NOT NULL) OR (need = 2 AND l2 IS NOT NULL) OR (need = 3 AND l3 IS NOT NULL) OR (need = 4 AND l4 IS NOT NULL)) GROUP BY ALL", *LAB))
def computation(spark, d):
    q = questions(named(spark, d))
    return q.groupBy("qtype", Q.computation(F.col("question"), F.col("options")).alias("computation")).agg(F.count(F.lit(1)).alias("n"))
