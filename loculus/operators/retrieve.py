"""Entities by category or label, rows a label, the top-down view, and entities added for names that were not found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.tables import COLORS, SYNONYMS
from loculus.functions.texts import missing_names
from loculus.operators.beliefs import entity_beliefs
from loculus.operators.lookup import all_matches, not_found
from loculus.operators.matching import holding_pairs

# Words of names that stand for no object.
NO_OBJECTS = ("the room", "into", "toward")


def by_category(names: DataFrame, entities: DataFrame, column: str = "label") -> DataFrame:
    """names: scene, name. Each distinct name with the entities of its scene whose column equals it."""
    n = names.select("scene", "name").distinct()
    return n.join(entities, (n["scene"] == entities["scene"]) & (n["name"] == entities[column])).drop(n["scene"])


def within(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Each distinct name with the entities of its scene whose label holds it or lies in it; names and labels meet through an index."""
    n = names.select("scene", "name").filter("name IS NOT NULL").distinct()
    words = holding_pairs(n.select("name"), entities.select("label"))
    return n.join(words, "name").join(entities, ["scene", "label"])


def best_observed(names: DataFrame, entities: DataFrame) -> DataFrame:
    """scene, name, label, obs_count: of the entities that a name fits the one seen most often, the first of equals."""
    best = F.max_by(F.struct("label", "obs_count"), F.struct("obs_count", -F.col("entity_ord")))
    return within(names, entities).groupBy("scene", "name").agg(best.alias("e")).select("scene", "name", "e.*")


def instance_counts(names: DataFrame, entities: DataFrame) -> DataFrame:
    """scene, name, n: how many entities each name fits, 0 without any."""
    n = names.select("scene", "name").distinct()
    found = within(names, entities).groupBy("scene", "name").agg(F.count(F.lit(1)).alias("found"))
    return n.join(found, ["scene", "name"], "left").select("scene", "name", F.coalesce("found", F.lit(0)).alias("n"))


def of_tasks(rows: DataFrame, types: list[str], column: str = "task") -> DataFrame:
    """Rows whose task holds one of the words; none without words."""
    return rows.filter(reduce(lambda a, b: a | b, [F.col(column).contains(t) for t in types], F.lit(False)))


def highlighted(entities: DataFrame, names: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """Entities that at least one of the names of their scene's questions matches."""
    hit = all_matches(names, entities.select("scene", "label"), synonyms).select("scene", "label").distinct()
    return entities.join(hit, ["scene", "label"], "left_semi")


def label_rows(instances: DataFrame) -> DataFrame:
    """One row a label of its instances: how many, place and size of the one seen most (the first of equals), mean existence, first and last frame."""
    best = F.max_by(F.struct("mx", "my", "mz", "w3", "h3"), F.struct("obs_count", -F.col("entity_ord")))
    r = instances.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("count"), F.avg("existence").alias("avg_confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), best.alias("b"))
    return r.select("scene", F.concat(F.lit("entity_"), "label").alias("entity_id"), "label", "count", "avg_confidence", "first_seen", "last_seen", "b.*", F.coalesce("b.mz", F.lit(2.5)).alias("depth_median"))


def least_sure(det: DataFrame, least: int = 4) -> DataFrame:
    """Of each label with at least `least` detections the third that is least sure, one at least; of equals the first."""
    n = det.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    d = det.join(n, ["scene", "label"]).withColumn("c", F.round("confidence", 9))
    rank = F.row_number().over(Window.partitionBy("scene", "label").orderBy("c", "det_ord"))
    return d.withColumn("k", rank).filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") / 3))).drop("c", "k", "n")


def color(category: Column, table=COLORS) -> Column:
    """Red, green and blue of the first row whose word a category holds, else of the last row."""
    rgb = lambda r: F.array(*[F.lit(v) for v in r[1:]])
    return reduce(lambda out, r: F.when(F.lower(category).contains(r[0]), rgb(r)).otherwise(out), reversed(table[:-1]), rgb(table[-1]))


def top_down(entities: DataFrame, cameras: DataFrame, image: int = 640, margin: int = 60) -> DataFrame:
    """scene, label, px, pz: places in an image of the XZ plane that holds all of a scene's entities and cameras, a twentieth of their span wider each way."""
    at = entities.select("scene", F.col("mx").alias("x"), F.col("mz").alias("z")).unionByName(cameras.select("scene", F.col("cx").alias("x"), F.col("cz").alias("z")))
    b = at.groupBy("scene").agg(*[f(c).alias(f"{n}_{c}") for c in "xz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    span = {c: F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.5)) for c in "xz"}
    b = b.select("scene", *[(F.col(f"lo_{c}") - span[c] * 0.05).alias(f"lo_{c}") for c in "xz"], *[(F.col(f"hi_{c}") + span[c] * 0.05).alias(f"hi_{c}") for c in "xz"])
    b = b.withColumn("scale", (image - 2 * margin) / F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_z") - F.col("lo_z")))
    inside = lambda p: F.greatest(F.lit(margin), F.least(F.lit(image - margin), p.cast("int")))
    e = entities.join(b, "scene")
    return e.select("scene", "label", inside(margin + (F.col("mx") - F.col("lo_x")) * F.col("scale")).alias("px"), inside(image - margin - (F.col("mz") - F.col("lo_z")) * F.col("scale")).alias("pz"))


def names_to_add(replies: DataFrame, entities: DataFrame, most: int = 3, synonyms=SYNONYMS) -> DataFrame:
    """scene, name: of the first `most` names that a scene's replies (scene, text) say were not found, those of objects that no entity matches."""
    n = replies.select("scene", F.explode(F.slice(missing_names(F.col("text")), 1, most)).alias("name")).select("scene", F.lower(F.trim("name")).alias("name"))
    none = reduce(lambda a, b: a | b, [F.col("name").contains(w) for w in NO_OBJECTS], F.length("name") < 2)
    return not_found(n.filter(~none), entities, synonyms)


def add_missing(names: DataFrame, det: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """Beliefs of new entities, named as they were asked for, of all detections whose labels their names match; a name without any adds none."""
    return entity_beliefs(all_matches(names, det, synonyms).drop("label").withColumnRenamed("name", "label"))
