"""Relations between things of a scene, their graph, regions, and whole-map edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.geometry import relation_word
from loculus.operators.lookup import pairs
from loculus.operators.spatial import nearest_other


def relations(entities: DataFrame, most: float = 3.0, near: float = 1.0, next_to: float = 0.5, vertical: float = 0.3) -> DataFrame:
    """scene, subject, relation, object, distance: near or next_to by distance, below or above by height, for pairs nearer than `most`."""
    p = pairs(entities, most).filter(F.col("distance") < most)
    dy = F.col("b_my") - F.col("a_my")
    found = F.array_compact(F.array(
        F.when(F.col("distance") < next_to, F.struct(F.lit("next_to").alias("relation"), F.col("distance").alias("distance"))).when(F.col("distance") < near, F.struct(F.lit("near").alias("relation"), F.col("distance").alias("distance"))),
        F.when(F.abs(dy) > vertical, F.struct(F.when(dy > 0, "below").otherwise("above").alias("relation"), F.abs(dy).alias("distance"))),
    ))
    return p.select("scene", F.col("a_label").alias("subject"), F.col("b_label").alias("object"), F.explode(found).alias("r")).select("scene", "subject", "r.relation", "object", "r.distance")


def relation_graph(entities: DataFrame, most: float = 5.0) -> DataFrame:
    """Edges both ways between entities up to `most` apart: scene, source, target, distance, relation."""
    p = pairs(entities, most + 1e-9).filter(F.col("distance") <= most)
    d = tuple(F.col(f"b_m{c}") - F.col(f"a_m{c}") for c in "xyz")
    word = F.when(F.col("back"), relation_word(d, back=True)).otherwise(relation_word(d))
    return both_ways(p).select("scene", _end("a", "label").alias("source"), _end("b", "label").alias("target"), F.bround("distance", 2).alias("distance"), word.alias("relation"))


def both_ways(p: DataFrame) -> DataFrame:
    """Each pair twice, with `back` false and true, so pairs are made once."""
    return p.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))


def _end(side: str, column: str):
    """A column of one side of a pair, and of the other one on the way back."""
    return F.when(F.col("back"), F.col(f"{'b' if side == 'a' else 'a'}_{column}")).otherwise(F.col(f"{side}_{column}"))


def relation_counts(entities: DataFrame, most: float = 5.0, once: bool = False) -> DataFrame:
    """scene, source, target, relation, n: how many edges of relation_graph there are of each kind.

    once: each label is there once a scene, as in entity_beliefs, which groups by them. Then no two edges have source and target in common, so each
    is a group of its own and n is 1; edges, many times the entities, are neither sent nor held to be counted.
    """
    edges = relation_graph(entities, most).drop("distance")
    return edges.withColumn("n", F.lit(1).cast("long")) if once else edges.groupBy("scene", "source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


def of_object(rel: DataFrame, names: DataFrame) -> DataFrame:
    """names: scene, name. Each with the relations of its scene that have it on either side: name and the columns of rel."""
    sides = rel.withColumn("name", F.explode(F.array_distinct(F.array("subject", "object"))))
    return sides.join(names.select("scene", "name").distinct(), ["scene", "name"])


def nearby(entities: DataFrame, radius: float) -> DataFrame:
    """For each entity those within the radius, nearest first: scene, label, other, distance, rank."""
    p = pairs(entities, radius + 1e-9).filter(F.col("distance") <= radius)
    both = both_ways(p).select("scene", _end("a", "label").alias("label"), _end("b", "label").alias("other"), "distance", _end("b", "entity_ord").alias("o"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("scene", "label").orderBy(F.round("distance", 9), "o"))).drop("o")


def assign_regions(entities: DataFrame, regions: DataFrame) -> DataFrame:
    """Each region's entities; regions: region, lo_x ... hi_z, a short list that is broadcast after its size is checked by the caller."""
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(f"m{c}").between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return entities.join(regions, inside).select("scene", "region", "label")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, those with keys in new replaced by the last of new's; new carries `ord`."""
    last = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ord")))).filter("_k = 1").drop("_k", "ord")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def remove(objects: DataFrame, rel: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects without those gone (scene, label), and relations without any that name one of them."""
    s = gone.select("scene", F.col("label").alias("subject"))
    o = gone.select("scene", F.col("label").alias("object"))
    return objects.join(gone, ["scene", "label"], "left_anti"), rel.join(s, ["scene", "subject"], "left_anti").join(o, ["scene", "object"], "left_anti")


def topology(entities: DataFrame) -> DataFrame:
    """Each entity with the nearest other of its scene (nulls where it is alone), and the scene's mean and greatest distance of pairs and their number."""
    p = pairs(entities).groupBy("scene").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.count(F.lit(1)).alias("n_pairs"))
    return nearest_other(entities).join(p, "scene", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


#: No extent counts as more than this, so that pairs which conflict are nearer than half of it.
LEAST_EXTENT = 0.3


def spatial_conflicts(entities: DataFrame) -> DataFrame:
    """Pairs nearer than a quarter of the sum of their least extents."""
    s = entities.select("scene", "label", F.least("w3", "h3", F.lit(LEAST_EXTENT)).alias("s"))
    p = pairs(entities, LEAST_EXTENT / 2 + 1e-6).filter(F.col("distance") < LEAST_EXTENT / 2 + 1e-6)
    p = p.join(s.select("scene", F.col("label").alias("a_label"), F.col("s").alias("sa")), ["scene", "a_label"]).join(s.select("scene", F.col("label").alias("b_label"), F.col("s").alias("sb")), ["scene", "b_label"])
    return p.filter(F.col("distance") < (F.col("sa") + F.col("sb")) / 4).select("scene", "a_label", "b_label")
