"""Labels for things: by size, by colour table, by boxes that hold their projection; and edits of a map by frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.questions import frame_spec
from loculus.functions.tables import SYNONYMS
from loculus.operators.beliefs import entity_beliefs
from loculus.operators.lookup import first_match

# How uncertain a place may be for a task before it is looked at again.
RADII = {"rel_direction": 1.0, "abs_distance": 0.5, "rel_distance": 0.8, "counting": float("inf")}


#: Boxes of a frame that a row holds at most.
HELD = 256


def size_label(w: Column, h: Column, d: Column) -> Column:
    big, small, volume = F.greatest(w, h, d), F.least(w, h, d), w * h * d
    return F.when(h > 2.0, "tall furniture").when((big > 1.5) & (small < 0.3), "table or desk").when(volume < 0.1, "small object").when((h > 0.3) & (h < 1.0) & (volume < 0.5), "chair").otherwise("furniture")


def look_again(existence: Column, radius: Column, task: Column) -> Column:
    """Whether an entity needs another look: it may not exist, or its place is too uncertain for the task."""
    bound = F.lit(1.0)
    for name, value in RADII.items():
        bound = F.when(task == name, F.lit(value)).otherwise(bound)
    return (existence < 0.6) | (radius > bound)


def project(p: tuple[Column, Column, Column], c: tuple[Column, Column, Column], f: tuple[Column, Column, Column], fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixels of a point for a camera at c looking along f, without rotation and by distance in place of depth; null behind or within 0.1."""
    d = [a - b for a, b in zip(p, c)]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    seen = (d[0] * f[0] + d[1] * f[1] + d[2] * f[2] >= 0) & (n >= 0.1)
    return F.when(seen, F.try_divide(fx * d[0], n) + cx), F.when(seen, F.try_divide(fy * d[1], n) + cy)


def label_by_boxes(points: DataFrame, boxes: DataFrame, width: float, height: float) -> DataFrame:
    """points: scene, frame, thing, u, v (null: not seen). boxes: scene, frame, label, confidence, x1, y1, x2, y2.

    A thing gets the surest box that holds its point (of equals the one whose middle is nearest), else the nearest box within 30 %
    of the frame at half its confidence, else "object"; "unknown" where it isn't seen. Things meet a frame's boxes by HELD of them in a row.
    """
    w = Window.partitionBy("scene", "frame").orderBy("x1", "y1")
    b = boxes.withColumn("_part", F.floor((F.row_number().over(w) - 1) / HELD)).groupBy("scene", "frame", "_part").agg(F.collect_list(F.struct("label", "confidence", "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("bu"), ((F.col("y1") + F.col("y2")) / 2).alias("bv"))).alias("_b"))
    j = points.join(b, ["scene", "frame"], "left")
    u, v = F.col("u"), F.col("v")
    inside = F.filter("_b", lambda x: u.between(x["x1"], x["x2"]) & v.between(x["y1"], x["y2"]))
    share = lambda x: F.sqrt(F.pow((u - x["bu"]) / width, 2) + F.pow((v - x["bv"]) / height, 2))
    far = lambda x: F.sqrt(F.pow(u - x["bu"], 2) + F.pow(v - x["bv"], 2))
    j = j.select("scene", "frame", "thing", "u", F.size(F.filter("_b", lambda x: x["label"].isNotNull())).alias("n"), F.array_max(F.transform(inside, lambda x: F.struct(x["confidence"].alias("confidence"), (-share(x)).alias("s"), x["label"].alias("label")))).alias("in"),
                 F.array_min(F.transform("_b", lambda x: F.struct(far(x).alias("far"), x["label"].alias("label"), x["confidence"].alias("confidence")))).alias("near"), F.array_min(F.transform("_b", far)).alias("far"))
    g = j.groupBy("scene", "frame", "thing").agg(F.first("u").alias("u"), F.sum(F.greatest("n", F.lit(0))).alias("n"), F.max("in").alias("in"), F.min("near").alias("near"), F.min("far").alias("far"))
    close = F.col("far") < max(width, height) * 0.3
    label = F.when(F.col("u").isNull(), "unknown").when(F.col("in").isNotNull(), F.col("in.label")).when(close, F.col("near.label")).otherwise("object")
    sure = F.when(F.col("u").isNull(), 0.0).when(F.col("in").isNotNull(), F.col("in.confidence")).when(close, F.col("near.confidence") * 0.5).when(F.col("n") > 0, 0.3).otherwise(0.1)
    return g.select("scene", "frame", "thing", label.alias("label"), sure.alias("confidence"))


def filter_frames(det: DataFrame, edits: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """Entities after edits (scene, name, spec such as "3,5-8"): the first entity that a name means loses its detections of those frames and is summed up again; without any left it goes."""
    ent = entity_beliefs(det)
    e = edits.select("scene", F.lower(F.trim("name")).alias("name"), frame_spec(F.col("spec")).alias("bad"))
    hit = e.join(first_match(e.select("scene", "name"), ent, ["label"], synonyms), ["scene", "name"]).select("scene", F.col("e.label").alias("label"), F.explode("bad").alias("frame_order")).distinct()
    return entity_beliefs(det.join(hit, ["scene", "label", "frame_order"], "left_anti"))


def belief_probe(questions: DataFrame, entities: DataFrame, stage: str, synonyms=SYNONYMS) -> DataFrame:
    """A snapshot: stage, qid, number of named entities, their mean uncertainty (1 without any). questions: qid, scene, names."""
    one = questions.select("qid", "scene", F.explode_outer("names").alias("name"))
    found = first_match(one.select("scene", "name"), entities, ["label", "position_uncertainty"], synonyms)
    j = one.join(found, ["scene", "name"], "left")
    return j.groupBy("qid").agg(F.count("e").alias("n_entities"), F.coalesce(F.avg("e.position_uncertainty"), F.lit(1.0)).alias("mean_uncertainty")).withColumn("stage", F.lit(stage))


def room_from_planes(planes: DataFrame, points: DataFrame) -> DataFrame:
    """scene, floor, ceiling, and the room's bounds: horizontal planes by height, walls where they narrow the cloud's box. planes: scene, nx, ny, nz, px, py, pz, kind."""
    flat = planes.filter("kind = 'horizontal'").groupBy("scene").agg(F.min("py").alias("low"), F.max("py").alias("high"), F.count(F.lit(1)).alias("n"), F.min_by("ny", "py").alias("ny"))
    walls = planes.filter("kind = 'vertical'").groupBy("scene").agg(*[f(F.when((F.abs(f"n{c}") > 0.7) & ((F.col(f"n{c}") > 0) == up), F.col(f"p{c}") + (-0.1 if up else 0.1))).alias(f"w{n}_{c}") for c in "xz" for up, f, n in ((True, F.max, "lo"), (False, F.min, "hi"))])
    box = points.groupBy("scene").agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"])
    j = box.join(flat, "scene", "left").join(walls, "scene", "left")
    down = (F.col("n") == 1) & (F.col("ny") < 0)
    floor = F.when(F.col("n").isNull() | down, F.col("lo_y")).otherwise(F.col("low"))
    ceiling = F.when((F.col("n") > 1) | down, F.col("high")).otherwise(F.col("hi_y"))
    return j.select("scene", floor.alias("floor"), ceiling.alias("ceiling"), *[F.greatest(f"lo_{c}", f"wlo_{c}").alias(f"lo_{c}") for c in "xz"], *[F.least(f"hi_{c}", f"whi_{c}").alias(f"hi_{c}") for c in "xz"])
