"""Queries over lookups by name, depth maps, camera paths, scales of frames, and the agent's corrections by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from loculus.functions import geometry as G
from loculus.functions import questions as Q
from loculus.functions.tables import CHOICE_TASKS, COLORS, NUMERIC_TASKS, TASK_PATTERNS
from loculus.operators import evolution as E
from loculus.operators import maps as M
from loculus.operators import retrieve as Rt
from loculus.operators.beliefs import entity_beliefs
from loculus.plans.answer_queries import LAB, named, questions
from loculus.plans.answers_sql import QST
from loculus.plans.belief_queries import scaled
from loculus.plans.fixtures import ALL_RANGES, ALL_SYNONYMS, cameras, d4, detections, read, rounded, sql_match, with_ctes
from loculus.plans.label_queries import R
from loculus.plans.process_queries import REF, SIZ, events, log_lines
from loculus.plans.registry import SQL, query
from loculus.sources import results as Res

NAM = "nam", "SELECT DISTINCT scene, split_part(label, ' ', 2) AS name FROM ent"
LAST = "lst", "SELECT scene, label, max(frame_idx) AS last_seen, least(1.0, 0.5 + 0.1 * count(*)) AS existence FROM det GROUP BY ALL"


def noun():
    return F.substring_index("label", " ", -1)


def entities(spark, d):
    return entity_beliefs(detections(spark, d))


def nouns(e):
    """What is asked for in each scene: the last words of its labels."""
    return e.select("scene", noun().alias("name")).distinct()


@query("f5b_by_category", with_ctes("SELECT nam.scene, name, label FROM nam JOIN ent ON ent.scene = nam.scene AND split_part(label, ' ', 2) = name", NAM))
def by_category(spark, d):
    e = entities(spark, d)
    return Rt.by_category(nouns(e), e.withColumn("category", noun()), "category").select("scene", "name", "label")


@query("f6_by_label", with_ctes("SELECT scene, label AS name, obs_count FROM ent"))
def by_label(spark, d):
    e = entities(spark, d)
    return Rt.by_category(nouns(e).unionByName(e.select("scene", F.col("label").alias("name"))), e).select("scene", "name", "obs_count")


@query("f8_best_observed", with_ctes("SELECT nam.scene, name, arg_max(label, (obs_count, -entity_ord)) AS label, max(obs_count) AS obs_count FROM nam JOIN ent ON ent.scene = nam.scene AND (contains(label, name) OR contains(name, label)) GROUP BY nam.scene, name", NAM))
def best_observed(spark, d):
    e = entities(spark, d)
    return Rt.best_observed(nouns(e), e)


@query("r6d_instance_counts", with_ctes("SELECT a.scene, name, count(label) AS n FROM (SELECT scene, name FROM nam UNION SELECT scene, 'zebra' FROM ent) a LEFT JOIN ent ON ent.scene = a.scene AND (contains(label, name) OR contains(name, label)) GROUP BY a.scene, name", NAM))
def instance_counts(spark, d):
    e = entities(spark, d)
    return Rt.instance_counts(nouns(e).unionByName(e.select("scene", F.lit("zebra").alias("name"))), e)


@query("f10_of_tasks", f"SELECT task, count(*) AS n FROM ({SQL['x12_log_lines']}) WHERE contains(task, 'direction') OR contains(task, 'size') GROUP BY task")
def of_tasks(spark, d):
    return Rt.of_tasks(Res.parse_lines(log_lines(spark, d)), ["direction", "size"]).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("j21_highlighted", with_ctes(f"SELECT scene, label FROM ent WHERE EXISTS (SELECT 1 FROM (SELECT scene, split_part(label, ' ', 2) AS name FROM ent WHERE entity_ord = 1) n WHERE n.scene = ent.scene AND {sql_match('lower(n.name)', 'lower(ent.label)')})"))
def highlighted(spark, d):
    e = entities(spark, d)
    return Rt.highlighted(e, e.filter("entity_ord = 1").select("scene", noun().alias("name")), ALL_SYNONYMS).select("scene", "label")


@query("a20_label_rows", with_ctes(f"SELECT scene, 'entity_' || noun AS entity_id, noun AS label, count(*) AS count, {d4('avg(existence)')} AS avg_confidence, min(first_seen) AS first_seen, max(last_seen) AS last_seen, " + ", ".join(f"{d4(f'arg_max({c}, (obs_count, -entity_ord))')} AS {c}" for c in ("mx", "my", "mz", "w3", "h3")) + f", {d4('arg_max(mz, (obs_count, -entity_ord))')} AS depth_median FROM (SELECT ent.*, last_seen, existence, split_part(ent.label, ' ', 2) AS noun FROM ent JOIN lst USING (scene, label)) GROUP BY scene, noun", LAST))
def label_rows(spark, d):
    """Each entity is an instance of its noun."""
    e = entities(spark, d).withColumns({"existence": F.least(F.lit(1.0), 0.5 + 0.1 * F.col("obs_count")), "last_seen": F.array_max("support_frames")})
    return rounded(Rt.label_rows(e.withColumn("label", noun())))


@query("o5_least_sure", with_ctes("SELECT scene, label, frame_order, det_ord FROM (SELECT *, count(*) OVER (PARTITION BY scene, label) AS n, row_number() OVER (PARTITION BY scene, label ORDER BY round(confidence, 9), det_ord) AS k FROM det) WHERE n >= 4 AND k <= greatest(1, n // 3)"))
def least_sure(spark, d):
    return Rt.least_sure(detections(spark, d)).select("scene", "label", "frame_order", "det_ord")


@query("p38_colors", with_ctes("SELECT label, CASE " + " ".join(f"WHEN contains(label, '{w}') THEN '{r},{g},{b}'" for w, r, g, b in COLORS[:-1]) + f" ELSE '{','.join(map(str, COLORS[-1][1:]))}' END AS rgb FROM (SELECT DISTINCT label FROM ent UNION SELECT unnest([{', '.join(repr('old ' + r[0]) for r in COLORS)}]))"))
def colors(spark, d):
    e = entities(spark, d).select("label").union(spark.createDataFrame([("old " + r[0],) for r in COLORS], "label string")).distinct()
    return e.select("label", F.array_join(Rt.color(F.col("label")).cast("array<string>"), ",").alias("rgb"))


TOP = "tdn", "SELECT scene, lx - xr * 0.05 AS lx, hx + xr * 0.05 AS hx, lz - zr * 0.05 AS lz, hz + zr * 0.05 AS hz FROM (SELECT scene, min(x) AS lx, max(x) AS hx, min(z) AS lz, max(z) AS hz, greatest(max(x) - min(x), 0.5) AS xr, greatest(max(z) - min(z), 0.5) AS zr FROM plc GROUP BY scene)"


@query("p39_top_down", with_ctes("SELECT ent.scene, label, greatest(60, least(580, trunc(60 + (mx - lx) * (520 / greatest(hx - lx, hz - lz)))::INTEGER)) AS px, greatest(60, least(580, trunc(580 - (mz - lz) * (520 / greatest(hx - lx, hz - lz)))::INTEGER)) AS pz FROM ent JOIN tdn USING (scene)", TOP))
def top_down(spark, d):
    det = detections(spark, d)
    return Rt.top_down(entity_beliefs(det), cameras(det))


# What a detector's vocabulary lacked, and what a tool said of it: three names count, of which one is no object; a fourth comes too late.
LACKED, REPLY = ("gear", "plate", "gizmo"), "'gear' not found; 'the room' not found; 'plate' not found; 'gear' not found; 'gizmo' not found"


@query("e3_auto_add", with_ctes(f"SELECT scene, name AS label, count(*) AS obs_count, min(frame_idx) AS first_seen, {d4('sum(w * x) / sum(w)')} AS mx, {d4('sum(w * y) / sum(w)')} AS my, {d4('sum(w * z) / sum(w)')} AS mz, {d4('avg(confidence)')} AS confidence FROM detw JOIN (VALUES ('gear'), ('plate')) n(name) ON {sql_match('name', 'lower(label)')} GROUP BY scene, name"))
def auto_add(spark, d):
    """E2 and E3: the entities of a map without some nouns, and those added for the names that a reply calls missing."""
    det = detections(spark, d)
    grid = entity_beliefs(det).filter(~noun().isin(*LACKED))
    names = Rt.names_to_add(det.select("scene").distinct().withColumn("text", F.lit(REPLY)), grid, synonyms=ALL_SYNONYMS)
    return rounded(Rt.add_missing(names, det, ALL_SYNONYMS).select("scene", "label", "obs_count", "first_seen", "mx", "my", "mz", "confidence"))


@query("x3_task_types", with_ctes("SELECT kind || '-' || scene || '-' || k AS qid, CASE WHEN k % 3 = 0 THEN 'room_size_estimation' " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{t}'" for t, found in TASK_PATTERNS for p in found) + f" ELSE '{TASK_PATTERNS[0][0]}' END AS task FROM qst", *LAB, QST))
def task_types(spark, d):
    """A third of the questions name their type, a third an unknown one, the others none."""
    q = questions(named(spark, d)).withColumn("k", F.substring_index("qid", "-", -1).cast("int") % 3)
    given = F.when(F.col("k") == 0, "room_size_estimation").when(F.col("k") == 1, "riddle")
    return q.select("qid", Q.task_of(F.col("question"), given).alias("task"))


TYPES = (*CHOICE_TASKS, *NUMERIC_TASKS, "other")
EVO = with_ctes("", *SIZ).replace("ent AS MATERIALIZED (SELECT e.*", "ent0 AS MATERIALIZED (SELECT e.*").replace(", plc AS MATERIALIZED (", ", ent AS MATERIALIZED (SELECT * FROM ent0 WHERE round(confidence, 9) >= 0.7), plc AS MATERIALIZED (")
STRATEGY = "CASE " + " ".join(f"WHEN contains(qtype, '{w}') THEN '{s}'" for w, s in E.STRATEGIES) + " ELSE 'sizes' END"


def evolved(spark, d):
    """A question of each type in every scene."""
    det = detections(spark, d)
    e = entity_beliefs(det).withColumn("confidence", F.round("confidence", 9))
    q = det.select("scene").distinct().select("scene", F.explode(F.array(*map(F.lit, TYPES))).alias("qtype")).withColumn("qid", F.concat_ws("-", "scene", "qtype"))
    return rounded(E.evolve(q, e, det, 0.7, REF, ALL_RANGES, 5.0))


query("e15_evolve", EVO + f"""SELECT q.scene || '-' || qtype AS qid, strategy, e.label, CASE WHEN strategy = 'counts' THEN c.count ELSE count_in_frame END AS count, {d4("CASE WHEN strategy = 'sizes' THEN s.w * s.fix ELSE w3 END")} AS w3, {d4("CASE WHEN strategy = 'sizes' THEN s.h * s.fix ELSE h3 END")} AS h3,
  {", ".join(d4(f"CASE strategy WHEN 'sizes' THEN m{c} * s.factor WHEN 'distances' THEN m{c} * shrink WHEN 'directions' THEN coalesce(r.{c}, m{c}) ELSE m{c} END") + f" AS m{c}" for c in "xyz")}, CASE WHEN strategy = 'first_seen' THEN g.first_sure ELSE first_seen END AS first_seen
  FROM (SELECT *, {STRATEGY} AS strategy FROM (SELECT DISTINCT scene FROM det), (SELECT unnest([{', '.join(repr(t) for t in TYPES)}]) AS qtype)) q JOIN (SELECT *, CASE WHEN count(*) OVER w >= 2 AND max(mz) OVER w > 5 THEN 5 / max(mz) OVER w * 0.9 ELSE 1 END AS shrink FROM ent WINDOW w AS (PARTITION BY scene)) e ON e.scene = q.scene
  JOIN siz s ON s.scene = e.scene AND s.label = e.label JOIN ({SQL['e9_counts']}) c ON c.scene = e.scene AND c.label = e.label JOIN ({SQL['w4_gaps']}) g ON g.scene = e.scene AND g.label = e.label
  LEFT JOIN (SELECT scene, label, median(x) AS x, median(y) AS y, median(z) AS z FROM det GROUP BY ALL HAVING count(*) >= 3) r ON r.scene = e.scene AND r.label = e.label""")(evolved)


@query("r14e_key_frames", with_ctes("SELECT DISTINCT scene, unnest([first_seen, last_seen]) AS frame FROM ent JOIN lst USING (scene, label)", LAST))
def key_frames(spark, d):
    """The frames in which entities are first and last seen."""
    return entities(spark, d).select("scene", F.explode(F.array("first_seen", F.array_max("support_frames"))).alias("frame")).distinct()


@query("u5_vocabulary", with_ctes("SELECT scene, string_agg(word, ',' ORDER BY word) AS words FROM (SELECT scene, split_part(label, ' ', 2) AS word FROM ent UNION SELECT scene, unnest(['chair', 'gear', 'table']) FROM ent) GROUP BY scene"))
def vocabulary(spark, d):
    """The nouns of a scene's questions put into the first batch of words to detect."""
    e = entities(spark, d).groupBy("scene").agg(F.collect_set(noun()).alias("extra"))
    return e.select("scene", F.array_join(F.array_sort(F.array_union("extra", F.array(*map(F.lit, ["chair", "gear", "table"])))), ",").alias("words"))


PIX = "pix", "SELECT vec_id, i // 8 AS v, i % 8 AS u, e AS s, (e + 1) / 2 AS g FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i FROM embeddings)"


@query("w11_sobel", f"WITH {PIX[0]} AS ({PIX[1]}), w AS (SELECT vec_id, v, u, coalesce(lead(s) OVER r, 0) - coalesce(lag(s) OVER r, 0) AS d, coalesce(lag(s) OVER r, 0) + 2 * s + coalesce(lead(s) OVER r, 0) AS m FROM pix WINDOW r AS (PARTITION BY vec_id, v ORDER BY u)) SELECT vec_id, v, u, {d4('coalesce(lag(d) OVER c, 0) + 2 * d + coalesce(lead(d) OVER c, 0)')} AS grad_x, {d4('coalesce(lead(m) OVER c, 0) - coalesce(lag(m) OVER c, 0)')} AS grad_y FROM w WINDOW c AS (PARTITION BY vec_id, u ORDER BY v)")
def sobel(spark, d):
    """Each vector is a depth map of 8 x 8."""
    p = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    p = p.select("vec_id", F.floor(F.col("i") / 8).alias("v"), (F.col("i") % 8).cast("long").alias("u"), F.col("e").cast("double").alias("depth"))
    return rounded(M.sobel(p, "vec_id").drop("depth"))


def _boxed(source: str, *columns: str) -> str:
    return f"SELECT q.vec_id, a.t AS v, b.t AS u, {', '.join(f'avg({e}) AS {n}' for n, e in (c.split(' := ') for c in columns))} FROM {source} q JOIN mir a ON a.q = q.v JOIN mir b ON b.q = q.u GROUP BY 1, 2, 3"


@query("w12_guided_filter", f"WITH {PIX[0]} AS ({PIX[1]}), mir AS (SELECT t, CASE WHEN t + k < 0 THEN -(t + k) WHEN t + k > 7 THEN 14 - (t + k) ELSE t + k END AS q FROM (SELECT unnest(range(8)) AS t), (SELECT unnest(range(-4, 4)) AS k)), bx AS ({_boxed('pix', 'mg := g', 'ms := s', 'gg := g * g', 'gs := g * s')}), ab AS (SELECT vec_id, v, u, (gs - mg * ms) / (gg - mg * mg + 1e-3) AS a, ms - (gs - mg * ms) / (gg - mg * mg + 1e-3) * mg AS b FROM bx), mm AS ({_boxed('ab', 'ma := q.a', 'mb := q.b')}) SELECT vec_id, v * 8 + u AS i, {d4('ma * g + mb')} AS smooth FROM mm JOIN pix USING (vec_id, v, u)")
def guided_filter(spark, d):
    m = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s")).withColumn("g", F.transform("s", lambda x: (x + 1) / 2))
    return rounded(m.select("vec_id", F.posexplode(M.guided(F.col("g"), F.col("s"), 8, 8)).alias("i", "smooth")).withColumn("i", F.col("i").cast("long")))


@query("w16_poses", f"""WITH st AS (SELECT user_id, event_id, t, (event_id % 7 - 3) / 10.0::DOUBLE AS a, value / 100 AS tx, (event_id % 4)::DOUBLE AS tz FROM (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events)), cu AS (SELECT *, sum(a) OVER (PARTITION BY user_id ORDER BY t, event_id) AS now, sum(a) OVER (PARTITION BY user_id ORDER BY t, event_id) - a AS before FROM st)
  SELECT event_id, {d4('cos(now)')} AS cos, {d4('sin(now)')} AS sin, {d4('0.1 * sum(cos(before) * tx + sin(before) * tz) OVER w')} AS x, {d4('0.1 * sum(cos(before) * tz - sin(before) * tx) OVER w')} AS z FROM cu WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def poses(spark, d):
    """Turns about the vertical axis, for which SQL has sums of angles."""
    a, o, i = (F.col("event_id") % 7 - 3) / 10.0, F.lit(0.0), F.lit(1.0)
    s = events(spark, d).select("user_id", "event_id", F.col("t").alias("at"), F.array(F.cos(a), o, F.sin(a), o, i, o, -F.sin(a), o, F.cos(a)).alias("r"), F.array(F.col("value") / 100, o, (F.col("event_id") % 4).cast("double")).alias("t"))
    p = M.poses(s, "user_id", ["at", "event_id"])
    return rounded(p.select("event_id", F.col("r")[0].alias("cos"), F.col("r")[2].alias("sin"), F.col("t")[0].alias("x"), F.col("t")[2].alias("z")))


KNOWN = [("anvil", 0.3), ("bolt", 0.05)]


def _scales(cut: bool) -> str:
    low, high = ("greatest(y * 150, 0)", "least(y * 150 + height_3d * 60, 480)") if cut else ("y * 150", "y * 150 + height_3d * 60")
    fits = "hi > lo AND least(x * 60 + width_3d * 60, 640) > greatest(x * 60, 0)" if cut else "true"
    known = "CASE " + " ".join(f"WHEN contains(label, '{n}') THEN {s}" for n, s in KNOWN) + " END"
    rows = f"SELECT *, CASE WHEN {fits} AND (hi - lo) / 500 * z > 0.01 THEN k / ((hi - lo) / 500 * z) END AS e FROM (SELECT *, {low} AS lo, {high} AS hi, ({known})::DOUBLE AS k FROM det)"
    frames = f"SELECT scene, frame_order, count(*) FILTER (e > 0.1 AND e < 10) AS n, median(e) FILTER (e > 0.1 AND e < 10) AS m, median(z) AS dm FROM ({rows}) GROUP BY ALL"
    return with_ctes(f"SELECT scene, frame_order, n, {d4("coalesce(m, list_aggregate(h[-10:], 'median'), 2.5 / nullif(dm, 0), 1)")} AS scale FROM (SELECT *, list(m) FILTER (m IS NOT NULL) OVER (PARTITION BY scene ORDER BY frame_order) AS h FROM ({frames}))")


def _boxes(spark, d):
    return detections(spark, d).select("scene", "frame_order", "label", (F.col("x") * 60).alias("x1"), (F.col("y") * 150).alias("y1"), (F.col("x") * 60 + F.col("width_3d") * 60).alias("x2"), (F.col("y") * 150 + F.col("height_3d") * 60).alias("y2"), F.col("z").alias("depth"))


@query("w13b_scale_history_cut", _scales(True))
def scale_history_cut(spark, d):
    return rounded(M.scale_history(_boxes(spark, d), KNOWN, image=(640, 480)))


@query("w13c_scale_history", _scales(False))
def scale_history(spark, d):
    return rounded(M.scale_history(_boxes(spark, d), KNOWN))


LGT = "SELECT e.vec_id AS key, c.label, 10 * list_inner_product(e.embedding::DOUBLE[], c.m) AS logit FROM embeddings e, (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY label) c"


@query("o7_top_labels", f"SELECT key, label, {d4('p')} AS p, rank FROM (SELECT key, label, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS p, row_number() OVER (PARTITION BY key ORDER BY round(logit, 9) DESC, label) AS rank FROM (SELECT *, max(logit) OVER (PARTITION BY key) AS m FROM ({LGT})) WINDOW w AS (PARTITION BY key)) WHERE rank <= 5")
def top_labels(spark, d):
    """Logits: ten times the products of vectors with the ten labels' mean vectors, which are few."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    m = e.select("label", F.posexplode("e").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    product = F.aggregate(F.zip_with("e", "m", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    few = F.broadcast(m) if m.count() <= 10_000 else m
    logits = e.select(F.col("vec_id").alias("key"), "e").join(few, F.lit(True)).select("key", "label", (10 * product).alias("logit"))
    return rounded(M.top_labels(logits))


@query("p3_camera_to_world", with_ctes(f"SELECT scene, frame_order, 0.6 AS r11, -0.8 AS r13, 0.8 AS r31, {d4('-(0.6 * cx - 0.8 * cz)')} AS tx, {d4('-cy')} AS ty, {d4('-(0.8 * cx + 0.6 * cz)')} AS tz, '-0.8,0.0,0.6' AS forward FROM cam"))
def camera_to_world(spark, d):
    """The matrix that takes camera coordinates to the world's, of world-to-camera (R, t): R' beside -R' t; and the view, R's third row."""
    r = [F.lit(float(x)) for x in R]
    t = G.rotate_back(r, (F.col("cx"), F.col("cy"), F.col("cz")))
    one = cameras(detections(spark, d)).select("scene", "frame_order", r[0].alias("r11"), r[6].alias("r13"), r[2].alias("r31"), *[(-v).alias(f"t{c}") for v, c in zip(t, "xyz")], F.array_join(F.array(*r[6:9]).cast("array<string>"), ",").alias("forward"))
    return rounded(one)


@query("p11_grid_metres", with_ctes("SELECT scene, label, " + ", ".join(f"{d4(f'trunc(greatest(0.0, least(1.0, (m{c} - lo_{c}) / (hi_{c} - lo_{c} + 1e-6))) * 63 + 1e-9) * mpg')} AS {c}" for c in "xyz") + " FROM ent JOIN bnd USING (scene) JOIN scl USING (scene)"))
def grid_metres(spark, d):
    """Cells of the grid in metres from its corner."""
    from loculus.operators.scale import grid_cells

    _, ent, _, bounds, scale = scaled(spark, d)
    g = grid_cells(ent, bounds).join(scale.select("scene", "mpg"), "scene")
    return rounded(g.select("scene", "label", *[(F.col(f"g{c}") * F.col("mpg")).alias(c) for c in "xyz"]))
