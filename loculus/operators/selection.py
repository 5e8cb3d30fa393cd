"""Which frames to look at: co-occurrence, union, scores, the best few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.tables import SYNONYMS
from loculus.operators.lookup import all_matches


def name_frames(q: DataFrame, entities: DataFrame, synonyms=SYNONYMS, most: int = 2) -> DataFrame:
    """q: qid, scene, names. qid, name, frame, sigma: frames of the first `most` entities that each name means, with the first one's uncertainty where it is in the frame."""
    one = q.select("qid", "scene", F.explode("names").alias("name"))
    m = all_matches(one, entities.select("scene", "label", "entity_ord", "support_frames", "position_uncertainty"), synonyms)
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("scene", "name").orderBy("entity_ord"))).filter(F.col("k") <= most)
    f = m.select("scene", "name", F.explode("support_frames").alias("frame"), F.when(F.col("k") == 1, F.col("position_uncertainty")).alias("s")).groupBy("scene", "name", "frame").agg(F.max("s").alias("sigma"))
    return one.join(f, ["scene", "name"]).select("qid", "name", "frame", "sigma")


def candidate_frames(frames: DataFrame, temporal: bool = False) -> DataFrame:
    """qid, frame: frames with two names at least; where a question has none, or for order questions, all frames."""
    n = frames.groupBy("qid", "frame").agg(F.countDistinct("name").alias("n"))
    if temporal:
        return n.select("qid", "frame")
    return n.withColumn("best", F.max("n").over(Window.partitionBy("qid"))).filter("n >= 2 OR best < 2").select("qid", "frame")


def scored_frames(frames: DataFrame, seen: DataFrame | None = None, temporal: bool = False, most: int | None = None) -> DataFrame:
    """The best frames of each question: qid, frame, score, rank. Score: names there, times their uncertainty (0.1 at least), times 0.3 if seen before."""
    known = frames.filter("sigma IS NOT NULL").groupBy("qid", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("sigma").alias("u"))
    c = candidate_frames(frames, temporal).join(known, ["qid", "frame"], "left")
    score = F.coalesce("n", F.lit(0)) * F.greatest(F.lit(0.1), F.coalesce("u", F.lit(0.0)))
    if seen is not None:
        c = c.join(seen.select("qid", "frame", F.lit(0.3).alias("old")), ["qid", "frame"], "left")
        score = score * F.coalesce("old", F.lit(1.0))
    c = c.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "frame"))
    return c.withColumn("rank", rank).filter(F.col("rank") <= (most or (12 if temporal else 8))).select("qid", "frame", "score", "rank")
