"""Queries over ordered values, frame selection, corrections, rounds, tracks and results."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from loculus.functions import questions as Q
from loculus.functions.geometry import cosine, frame_sample
from loculus.functions.tables import CHOICE_TASKS, NUMERIC_TASKS
from loculus.operators import evolution as E
from loculus.operators import relations as R
from loculus.operators import selection as Sel
from loculus.operators import series as S
from loculus.operators import planes as PL
from loculus.operators import tracking as T
from loculus.operators.beliefs import entity_beliefs
from loculus.operators.labels import room_from_planes
from loculus.operators.lookup import evenly, top_in
from loculus.operators.scale import stratified_sample
from loculus.operators.voxels import downsample
from loculus.plans.answer_queries import LAB, all_answers, named
from loculus.plans.fixtures import ALL_RANGES, ALL_SYNONYMS, TEST_SIZES, cameras, d4, detections, points, read, rounded, with_ctes
from loculus.plans.registry import query
from loculus.plans.space_queries import PRS
from loculus.session import cut
from loculus.sources import results as Res

EV = "SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events"


def events(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value", "event_type")


@query("w6_ema", f"SELECT user_id, event_id, {d4('ema')} AS ema FROM (SELECT user_id, unnest(ids) AS event_id, unnest(list_transform(range(len(v)), lambda k: list_reduce(v[1:k + 1], lambda a, x: 0.3 * x + 0.7 * a))) AS ema FROM (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids, list(value ORDER BY t, event_id) AS v FROM ({EV}) GROUP BY user_id))")
def ema(spark, d):
    return rounded(S.ema(events(spark, d), "user_id", ["t", "event_id"], "value").select("user_id", "event_id", "ema"))


K = [math.exp(-((i - 2) ** 2) / (2 * (5 / 6.0) ** 2)) for i in range(5)]


@query("w7_gaussian", f"SELECT user_id, event_id, {d4(' + '.join(f'coalesce({f}, 0) * {k / sum(K)!r}::DOUBLE' for f, k in zip(('lag(value, 2) OVER w', 'lag(value, 1) OVER w', 'value', 'lead(value, 1) OVER w', 'lead(value, 2) OVER w'), K)))} AS smooth FROM ({EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def gaussian(spark, d):
    return rounded(S.gaussian(events(spark, d), "user_id", ["t", "event_id"], "value").select("user_id", "event_id", "smooth"))


@query("w8_bilateral", f"""SELECT user_id, event_id, {d4("list_sum(list_transform(range(5), lambda i: t[i + 1] * exp(-(t[3] - t[i + 1]) * (t[3] - t[i + 1]) / 0.02) * exp(-(i - 2) * (i - 2) / 8.0))) / (list_sum(list_transform(range(5), lambda i: exp(-(t[3] - t[i + 1]) * (t[3] - t[i + 1]) / 0.02) * exp(-(i - 2) * (i - 2) / 8.0))) + 1e-6)")} AS smooth FROM (SELECT user_id, event_id,
  [coalesce(lag(value / 100, 2) OVER w, f), coalesce(lag(value / 100, 1) OVER w, f), value / 100, coalesce(lead(value / 100, 1) OVER w, l), coalesce(lead(value / 100, 2) OVER w, l)] AS t FROM (SELECT *, first_value(value / 100) OVER a AS f, last_value(value / 100) OVER a AS l FROM ({EV}) WINDOW a AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))""")
def bilateral(spark, d):
    e = events(spark, d).withColumn("v", F.col("value") / 100)
    return rounded(S.bilateral(e, "user_id", ["t", "event_id"], "v").select("user_id", "event_id", "smooth"))


@query("w9_normalised", f"SELECT event_id, {d4('(value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-6)')} AS norm FROM events WINDOW w AS (PARTITION BY user_id)")
def normalised(spark, d):
    return rounded(S.normalised(events(spark, d), ["user_id"], "value").select("event_id", "norm"))


@query("w10_differences", f"SELECT user_id, {d4('avg(diff)')} AS mean_diff, {d4('max(diff)')} AS max_diff FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS diff FROM ({EV})) GROUP BY user_id")
def differences(spark, d):
    return rounded(S.differences(events(spark, d), "user_id", ["t", "event_id"], "value").groupBy("user_id").agg(F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff")))


@query("w13_last_median", f"SELECT event_id, {d4('median(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS median FROM ({EV}) WHERE value IS NOT NULL")
def last_median(spark, d):
    return rounded(S.last_median(events(spark, d), "user_id", ["t", "event_id"], "value").select("event_id", "median"))


@query("w4_gaps", with_ctes(f"""SELECT scene, label, coalesce(min(frame_idx) FILTER (round(c, 9) > 0.4), min(frame_idx)) AS first_sure, {d4('avg(gap)')} AS mean_gap, max(gap) AS max_gap, CASE WHEN max(gap) < avg(gap) * 3 THEN 1.0 ELSE 0.5 END AS continuity
  FROM (SELECT *, lead(frame_idx) OVER (PARTITION BY scene, label ORDER BY frame_idx) - frame_idx AS gap FROM (SELECT scene, label, frame_idx, max(confidence) AS c FROM det GROUP BY ALL)) GROUP BY ALL"""))
def gaps(spark, d):
    return rounded(S.gaps(detections(spark, d)))


@query("w5_turns", with_ctes(f"""SELECT scene, entity_ord, {d4('a')} AS angle, CASE WHEN abs(a) < 30 THEN 'go forward' WHEN a > 0 THEN 'turn left' ELSE 'turn right' END AS turn FROM (SELECT scene, entity_ord, CASE WHEN a > 180 THEN a - 360 WHEN a < -180 THEN a + 360 ELSE a END AS a FROM (SELECT scene, entity_ord,
  degrees(atan2(lead(mz) OVER w - mz, lead(mx) OVER w - mx) - atan2(mz - lag(mz) OVER w, mx - lag(mx) OVER w)) AS a FROM ent WINDOW w AS (PARTITION BY scene ORDER BY entity_ord))) WHERE a IS NOT NULL"""))
def turns(spark, d):
    e = entity_beliefs(detections(spark, d)).select("scene", "entity_ord", F.col("mx").alias("x"), F.col("mz").alias("z"))
    return rounded(S.turns(e, "scene", ["entity_ord"]).select("scene", "entity_ord", "angle", "turn"))


@query("w1_stratified_sample", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE list_contains(list_transform(range(least(c, 10)), lambda i: CASE WHEN least(c, 10) > 1 AND i = least(c, 10) - 1 THEN c - 1 ELSE floor(i * ((c - 1) / greatest(least(c, 10) - 1, 1)))::BIGINT END), k)")
def stratified(spark, d):
    return stratified_sample(events(spark, d), "event_type", "event_id", 10).select("event_type", "event_id")


@query("w2_scene_shards", "SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // ceil(count(*) OVER () / 8)::BIGINT AS shard FROM (SELECT DISTINCT user_id FROM events)")
def scene_shards(spark, d):
    u = events(spark, d).select("user_id").distinct()  # names of scenes, not their rows
    k = F.row_number().over(Window.orderBy("user_id")) - 1
    return u.select("user_id", F.expr("ceil(count(*) OVER () / 8)").alias("size"), k.alias("k")).select("user_id", F.expr("k div size").alias("shard"))


@query("w3_first_seen", with_ctes("SELECT scene, label, row_number() OVER (PARTITION BY scene ORDER BY first_seen, entity_ord) AS rank FROM ent"))
def first_seen(spark, d):
    e = entity_beliefs(detections(spark, d))
    return e.select("scene", "label", F.row_number().over(Window.partitionBy("scene").orderBy("first_seen", "entity_ord")).alias("rank"))


@query("w15_nth_camera", with_ctes(f"SELECT scene, frame_idx, {d4('cx')} AS cx FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame_order) - 1 AS k FROM cam) WHERE k = 2"))
def nth_camera(spark, d):
    c = cameras(detections(spark, d))
    return rounded(c.withColumn("k", F.row_number().over(Window.partitionBy("scene").orderBy("frame_order")) - 1).filter("k = 2").select("scene", "frame_idx", "cx"))


@query("o6_top_detections", with_ctes("SELECT scene, frame_order, det_ord FROM (SELECT *, row_number() OVER (PARTITION BY scene, frame_order ORDER BY round(confidence, 9) DESC, det_ord) AS r FROM det) WHERE r <= 20"))
def top_detections(spark, d):
    return top_in(detections(spark, d), ["scene", "frame_order"], [F.desc(F.round("confidence", 9)), F.col("det_ord")], 20).select("scene", "frame_order", "det_ord")


@query("o3_even_frames", with_ctes("SELECT scene, label, array_to_string(CASE WHEN len(f) <= 3 THEN f ELSE list_transform(range(3), lambda i: f[(i * len(f) // 3) + 1]) END, ',') AS frames FROM (SELECT scene, label, list(frame_idx ORDER BY frame_idx) AS f FROM frm GROUP BY ALL)"))
def even_frames(spark, d):
    e = entity_beliefs(detections(spark, d))
    return e.select("scene", "label", F.array_join(evenly(F.col("support_frames"), 3).cast("array<string>"), ",").alias("frames"))


SEL = [
    *LAB,
    ("qn", "SELECT scene, k, unnest([label, l1, l2]) AS name FROM lab WHERE l2 IS NOT NULL"),
    ("two", "SELECT e.scene, m.name, e.label, position_uncertainty AS u, row_number() OVER (PARTITION BY e.scene, m.name ORDER BY entity_ord) AS r FROM ent e JOIN mat m USING (label)"),
    ("nf", "SELECT qn.scene, k, qn.name, frm.frame_idx AS frame, max(CASE WHEN r = 1 THEN u END) AS s FROM qn JOIN two ON two.scene = qn.scene AND two.name = qn.name AND r <= 2 JOIN frm ON frm.scene = qn.scene AND frm.label = two.label GROUP BY ALL"),
    ("cf", "SELECT scene, k, frame FROM (SELECT *, max(n) OVER (PARTITION BY scene, k) AS best FROM (SELECT scene, k, frame, count(DISTINCT name) AS n FROM nf GROUP BY ALL)) WHERE n >= 2 OR best < 2"),
    ("sf", "SELECT *, row_number() OVER (PARTITION BY scene, k ORDER BY round(score, 9) DESC, frame) AS rank FROM (SELECT cf.scene, cf.k, cf.frame, coalesce(n, 0) * greatest(0.1, coalesce(u, 0)) AS score FROM cf LEFT JOIN (SELECT scene, k, frame, count(*) AS n, sum(s) AS u FROM nf WHERE s IS NOT NULL GROUP BY ALL) x USING (scene, k, frame))"),
]


def triples(spark, d, ent=None):
    ent = named(spark, d) if ent is None else ent
    w = Window.partitionBy("scene").orderBy("k")
    lab = ent.select("scene", "label", F.col("entity_ord").alias("k")).withColumns({"l1": F.lead("label", 1).over(w), "l2": F.lead("label", 2).over(w)}).filter("l2 IS NOT NULL")
    return ent, lab.select(F.concat_ws("-", "scene", "k").alias("qid"), "scene", F.array("label", "l1", "l2").alias("names"))


@query("u1_cooccurrence_frames", with_ctes("SELECT scene || '-' || k AS qid, frame FROM cf", *SEL))
def cooccurrence(spark, d):
    ent, q = triples(spark, d)
    return Sel.candidate_frames(Sel.name_frames(q, ent, ALL_SYNONYMS))


@query("u2_union_frames", with_ctes("SELECT DISTINCT scene || '-' || k AS qid, frame FROM nf", *SEL))
def union_frames(spark, d):
    ent, q = triples(spark, d)
    return Sel.candidate_frames(Sel.name_frames(q, ent, ALL_SYNONYMS), temporal=True)


@query("o1_scored_frames", with_ctes(f"SELECT scene || '-' || k AS qid, frame, rank, {d4('score')} AS score FROM sf WHERE rank <= 4", *SEL))
def scored(spark, d):
    ent, q = triples(spark, d)
    return rounded(Sel.scored_frames(Sel.name_frames(q, ent, ALL_SYNONYMS), most=4))


@query("e9_counts", with_ctes("""SELECT scene, label, CASE WHEN sure < base THEN sure ELSE base END AS count, CASE WHEN sure < base THEN least(trust + 0.1, 0.95) ELSE trust END AS confidence FROM (SELECT *, CASE WHEN frames >= 3 THEN least(med, mode) ELSE med END AS base, CASE WHEN frames < 3 THEN 0.6 WHEN med = mode THEN 0.9 ELSE 0.7 END AS trust FROM
  (SELECT scene, label, count(*) AS frames, trunc(quantile_cont(n, 0.5))::INTEGER AS med, trunc(quantile_cont(sure, 0.5) FILTER (sure > 0))::INTEGER AS sure FROM fq GROUP BY ALL) JOIN (SELECT scene, label, arg_max(n, (c, -n)) AS mode FROM (SELECT scene, label, n, count(*) AS c FROM fq GROUP BY ALL) GROUP BY ALL) USING (scene, label))""",
    ("fq", "SELECT scene, label, frame_idx, count(*) AS n, count(*) FILTER (round(confidence, 9) > 0.5) AS sure FROM det GROUP BY ALL")))
def counts(spark, d):
    return E.counts(detections(spark, d))


REF = [(n, s) for n, s in TEST_SIZES]
SIZ = [
    ("fac", "SELECT scene, arg_max(f, (round(confidence, 9), -entity_ord)) AS factor FROM (SELECT *, (CASE " + " ".join(f"WHEN contains(label, '{n}') THEN {s}" for n, s in REF) + " END)::DOUBLE / greatest(w3, h3) AS f FROM ent WHERE greatest(w3, h3) > 0.01) WHERE f > 0.2 AND f < 5 GROUP BY scene"),
    ("siz", "SELECT *, coalesce(CASE WHEN s < lo * 0.3 OR s > hi * 3 THEN (lo + hi) / 2 / s ELSE 1 END, 1) AS fix FROM (SELECT ent.scene, label, entity_ord, coalesce(factor, 1) AS factor, greatest(w3, h3) * coalesce(factor, 1) AS s, w3 * coalesce(factor, 1) AS w, h3 * coalesce(factor, 1) AS h, mz * coalesce(factor, 1) AS z, (CASE " + " ".join(f"WHEN contains(label, '{r[0]}') THEN {r[1]}" for r in ALL_RANGES) + " END)::DOUBLE AS lo, (CASE " + " ".join(f"WHEN contains(label, '{r[0]}') THEN {r[2]}" for r in ALL_RANGES) + " END)::DOUBLE AS hi FROM ent LEFT JOIN fac ON fac.scene = ent.scene)"),
]


@query("e10_sizes", with_ctes(f"SELECT scene, label, {d4('factor')} AS factor, {d4('w * fix')} AS w3, {d4('h * fix')} AS h3 FROM siz", *SIZ))
def sizes(spark, d):
    return rounded(E.sizes(entity_beliefs(detections(spark, d)), REF, ALL_RANGES).select("scene", "label", "factor", "w3", "h3"))


@query("e11_distances", with_ctes(f"SELECT scene, label, {d4('CASE WHEN max(mz) OVER w > 5 THEN mz * (5 / max(mz) OVER w * 0.9) ELSE mz END')} AS mz, max(mz) OVER w - min(mz) OVER w < 0.5 AND count(*) OVER w > 5 AS flat FROM ent WINDOW w AS (PARTITION BY scene)"))
def distances(spark, d):
    return rounded(E.distances(entity_beliefs(detections(spark, d)), 5.0).select("scene", "label", "mz", "flat"))


@query("e12_directions", with_ctes(f"SELECT scene, label, n, {d4('x')} AS mx, {d4('y')} AS my, {d4('z')} AS mz, {d4('s')} AS stability FROM (SELECT scene, label, count(*) AS n, median(x) AS x, median(y) AS y, median(z) AS z, 1 / (1 + (stddev_pop(x) + stddev_pop(y) + stddev_pop(z)) / 3) AS s FROM (SELECT scene, label, x, y, z FROM det) GROUP BY ALL) WHERE n >= 3"))
def directions(spark, d):
    return rounded(E.directions(detections(spark, d)))


@query("f13_drop_unsure", with_ctes("SELECT scene, label FROM ent WHERE round(confidence, 9) >= 0.7"))
def drop_unsure(spark, d):
    return E.drop_unsure(entity_beliefs(detections(spark, d)).withColumn("confidence", F.round("confidence", 9)), 0.7).select("scene", "label")


@query("e16_critic", with_ctes("SELECT scene, CASE WHEN count(*) FILTER (confidence < 0.3) > 0 OR scene IN (SELECT p.scene FROM prs p JOIN ent a ON a.scene = p.scene AND a.label = al JOIN ent b ON b.scene = p.scene AND b.label = bl WHERE d < (least(a.w3, a.h3, 0.3) + least(b.w3, b.h3, 0.3)) / 4) THEN 're_observe' WHEN count(*) FILTER (greatest(w3, h3) > 10) > 0 THEN 'physics_violation' ELSE 'pass' END AS verdict FROM ent GROUP BY scene", PRS))
def critic(spark, d):
    e = entity_beliefs(detections(spark, d))
    return E.critic(e, R.spatial_conflicts(e))


def looks(q, rounds: int = 3):
    """Stand-ins for a model's looks: letters and confidences by arithmetic on a question's number."""
    r = q.select("qid", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    h = F.crc32(F.concat_ws("-", "qid", "round").cast("binary"))
    return r.select("qid", "round", F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), ((F.crc32(F.col("qid").cast("binary")) + F.col("round").cast("long") * (h % 2)) % 4 + 1).cast("int")).alias("answer"), (0.3 + (h % 60) / 100.0).alias("conf"))


@query("e7_belief_rounds")
def belief_rounds(spark, d):
    det = detections(spark, d)
    _, q = triples(spark, d, cut(entity_beliefs(det).select("scene", "label", "entity_ord")))
    return E.belief_rounds(q, det, looks(q), 3, ALL_SYNONYMS)


VOT = "v", "SELECT user_id AS qid, event_id, chr((65 + event_id % 4)::INTEGER) AS answer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round, 0.1 + (event_id % 9) / 10.0 AS conf FROM events"


@query("e7_weighted_vote", f"WITH {VOT[0]} AS ({VOT[1]}) SELECT qid, arg_max(answer, (round(w, 9), -o)) AS answer FROM (SELECT qid, answer, sum(CASE WHEN round = 0 THEN 3 ELSE round + 1 END * greatest(conf, 0.1)) AS w, min(round) AS o FROM v WHERE round <= 3 GROUP BY ALL) GROUP BY qid")
def weighted_vote(spark, d):
    v = events(spark, d).select(F.col("user_id").alias("qid"), F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("event_id") % 4 + 1).cast("int")).alias("answer"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("round"), (0.1 + (F.col("event_id") % 9) / 10.0).alias("conf"))
    return E.vote(v.filter("round <= 3"), 3)


@query("e8_median_vote")
def median_vote(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("qid"), F.format_string("about %.1f metres", "value").alias("text"))
    return E.median_vote(r, 1.0, 200.0)


@query("t1_tracks")
def tracks(spark, d):
    return rounded(T.track(detections(spark, d)))


@query("e22_room_planes")
def room_planes(spark, d):
    return PL.room_planes(downsample(points(spark, d), 0.5), near=0.1, least=10)


@query("e22_room_bounds")
def room_bounds(spark, d):
    """Floors, ceilings and walls from a room's planes, within its voxels' places."""
    p = downsample(points(spark, d), 0.5)
    return rounded(room_from_planes(PL.room_planes(p, near=0.1, least=10), p))


@query("a24_summary", with_ctes(f"SELECT kind, task, count(*) AS n, {d4('avg(score)')} AS score, {d4('avg(v7)')} AS v7, {d4('avg(score) - avg(v7)')} AS delta FROM (SELECT *, CASE WHEN task IN ({', '.join(repr(t) for t in CHOICE_TASKS)}) THEN 'choice' WHEN task IN ({', '.join(repr(t) for t in NUMERIC_TASKS)}) THEN 'numeric' ELSE 'other' END AS kind FROM (SELECT event_type AS e, list_extract([{', '.join(repr(t) for t in (*CHOICE_TASKS, *NUMERIC_TASKS, 'other_task'))}], event_id % 11 + 1) AS task, (event_id % 11) / 10.0 AS score, CASE WHEN event_id % 2 = 0 THEN (event_id % 7) / 10.0 END AS v7 FROM events)) GROUP BY GROUPING SETS ((kind, task), (kind), ())"))
def summary(spark, d):
    return rounded(Res.summarize(Res.parse_lines(log_lines(spark, d))))


def log_lines(spark, d):
    """Log lines with a result each, made of events."""
    names = F.array(*[F.lit(t) for t in (*CHOICE_TASKS, *NUMERIC_TASKS, "other_task")])
    e = events(spark, d)
    line = F.concat(F.lit("12:00 INFO ["), F.element_at(names, (F.col("event_id") % 11 + 1).cast("int")), F.lit("] ans=A gt=B score="), F.format_number((F.col("event_id") % 11) / 10.0, 1), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" then V7="), F.format_number((F.col("event_id") % 7) / 10.0, 1))).otherwise(F.lit("")))
    return e.select(line.alias("value"), F.lit("events").alias("source"))


@query("x12_log_lines", f"SELECT list_extract([{', '.join(repr(t) for t in (*CHOICE_TASKS, *NUMERIC_TASKS, 'other_task'))}], event_id % 11 + 1) AS task, 'A' AS answer, 'B' AS ground_truth, (event_id % 11) / 10.0 AS score, CASE WHEN event_id % 2 = 0 THEN (event_id % 7) / 10.0 END AS v7 FROM events")
def logs(spark, d):
    return Res.parse_lines(log_lines(spark, d)).drop("source")


@query("a34_relative_accuracy", "SELECT event_id, CASE WHEN t = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_filter(range(10), lambda i: abs(p - t) / (abs(t) + 1e-8) < 1 - (0.05::DOUBLE + i * 0.05::DOUBLE))) / 10.0 END AS mra FROM (SELECT event_id, value AS p, (event_id % 50)::DOUBLE AS t FROM events)")
def relative_accuracy(spark, d):
    return events(spark, d).select("event_id", Q.relative_accuracy(F.col("value"), (F.col("event_id") % 50).cast("double")).alias("mra"))


@query("p32_cosine", f"SELECT a.vec_id, b.vec_id AS other, {d4('list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))')} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosines(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("oe"))
    return rounded(e.join(o, "vec_id").select("vec_id", "other", cosine(F.col("embedding"), F.col("oe")).alias("cosine")))


@query("a11_mean_features", f"SELECT label, i, {d4('avg(v)')} AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def mean_features(spark, d):
    return rounded(read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.avg(F.col("v").cast("double")).alias("mean")))


@query("s9_frame_samples", "SELECT event_id, array_to_string(list_transform(range(16), lambda i: CASE WHEN i = 15 THEN event_id % 900 + 100 - 1 ELSE floor(i * ((event_id % 900 + 100 - 1) / 15::DOUBLE))::BIGINT END), ',') AS frames FROM events")
def frame_samples(spark, d):
    return events(spark, d).select("event_id", F.array_join(frame_sample((F.col("event_id") % 900 + 100), 16).cast("array<string>"), ",").alias("frames"))


@query("x16_softmax", f"SELECT event_id, letter, {d4('1 / (exp(a - m) + exp(b - m) + exp(c - m) + exp(d - m))')} AS p FROM (SELECT *, greatest(a, b, c, d) AS m, CASE greatest(a, b, c, d) WHEN a THEN 'A' WHEN b THEN 'B' WHEN c THEN 'C' ELSE 'D' END AS letter FROM (SELECT event_id, event_id % 7 / 2.0 AS a, event_id % 5 / 2.0 AS b, event_id % 3 * 1.0 AS c, event_id % 11 / 4.0 AS d FROM events))")
def softmax(spark, d):
    i = F.col("event_id")
    letter, p = S.softmax_choice(F.array(i % 7 / 2.0, i % 5 / 2.0, i % 3 * 1.0, i % 11 / 4.0))
    return rounded(events(spark, d).select("event_id", letter.alias("letter"), p.alias("p")))


@query("x21_frame_specs", "SELECT event_id, array_to_string(list_distinct_in_order, ',') AS frames FROM (SELECT event_id, [event_id % 9, event_id % 9 + 20, event_id % 9 + 21, event_id % 9 + 22] AS list_distinct_in_order FROM events)")
def frame_specs(spark, d):
    i = F.col("event_id") % 9
    return events(spark, d).select("event_id", F.array_join(Q.frame_spec(F.concat(i.cast("string"), F.lit(","), (i + 20).cast("string"), F.lit("-"), (i + 22).cast("string"))).cast("array<string>"), ",").alias("frames"))


@query("a23_task_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def histogram(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a26_wins_losses")
def wins_losses(spark, d):
    part = lambda n: F.split_part("qid", F.lit("-"), F.lit(n)).cast("long")
    rows = all_answers(spark, d).withColumn("ref", ((part(2) * 7 + part(3) * 3) % 10) / 10.0)
    return rows.groupBy("qtype").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > F.col("ref") + 0.05).alias("wins"), F.count_if(F.col("score") < F.col("ref") - 0.05).alias("losses"))


@query("s27_yaml_prompt", with_ctes("SELECT scene, len(t) AS n, md5(t) AS digest FROM (SELECT scene, 'entities:' || chr(10) || string_agg(printf('  - id: %s' || chr(10) || '    category: %s' || chr(10) || '    count: %d', entity_id, label, count_in_frame), chr(10) ORDER BY entity_ord) AS t FROM ent GROUP BY scene)"))
def yaml_prompt(spark, d):
    t = Res.entity_yaml(entity_beliefs(detections(spark, d))).select("scene", F.regexp_replace("text", r"    position: .*\n", "").alias("t"))
    return t.select("scene", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("s28_markdown_prompt")
def markdown_prompt(spark, d):
    return Res.entity_markdown(entity_beliefs(detections(spark, d)))

