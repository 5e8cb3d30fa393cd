"""Fuzzy joins of names with the entities of their scene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.tables import SYNONYMS
from loculus.operators.matching import name_pairs
from loculus.operators.spatial import offsets
from loculus.session import cut


#: How much of a cell the bound of pairs is, and a little for rounding.
REACH = 0.5 + 1e-9


def all_matches(names: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """names: scene, name. Each distinct name with every entity of its scene that it matches.

    Distinct names and the detector's vocabulary meet through an index, once for all scenes; what matches is then joined by scene
    and label, by equality.
    """
    n = names.select("scene", "name").filter("name IS NOT NULL").distinct()
    words = name_pairs(n.select("name"), entities.select("label"), synonyms)
    return n.join(words, "name").join(entities, ["scene", "label"])


def first_match(names: DataFrame, entities: DataFrame, columns: list[str], synonyms=SYNONYMS) -> DataFrame:
    """scene, name, e (struct of columns): of the entities that a name matches the first one. Many match, so labels alone are sent, and columns are taken from the one that is left."""
    m = all_matches(names, entities.select("scene", "label", "entity_ord"), synonyms)
    first = m.groupBy("scene", "name").agg(F.min_by("label", "entity_ord").alias("_l"))
    e = entities.select(F.col("scene").alias("_s"), F.col("label").alias("_l"), F.struct(*columns).alias("e"))
    return first.join(e.withColumnRenamed("_s", "scene"), ["scene", "_l"]).select("scene", "name", "e")


def scene_book(names: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """A row for each scene with entities: _names (map of each name asked there to the numbers of what it matches), _places and _sizes.

    names: scene, name. Of the entities that a name means, first is the number of the first one in _places (mx, my, mz, first_seen, obs_count), sure that of
    the surest one in _sizes (its greater side), n the greatest usual count. Questions look names up in the row of their scene, so however many
    names they have and whatever is asked, names meet entities once and questions are sent nowhere but to their scene.
    """
    by, has = Window.partitionBy("scene"), entities.columns
    use = {"mx": "double", "my": "double", "mz": "double", "first_seen": "int", "obs_count": "long", "count_in_frame": "int", "confidence": "double", "w3": "double", "h3": "double"}
    e = entities.select("scene", "label", "entity_ord", *[F.col(c) if c in has else F.lit(None).cast(k).alias(c) for c, k in use.items()])
    e = e.withColumns({"_first": F.row_number().over(by.orderBy("entity_ord", "label")), "_sure": F.row_number().over(by.orderBy(F.desc(F.round("confidence", 9)), F.asc_nulls_last("entity_ord"), "label"))})
    places, sizes = F.struct("_first", "mx", "my", "mz", "first_seen", "obs_count"), F.struct("_sure", F.greatest("w3", "h3").alias("size"))
    # texts are read for their names once; numbers alone are sent to be added up
    names = cut(names.select("scene", "name").filter("name IS NOT NULL").distinct())
    m = all_matches(names, e.select("scene", "label", "_first", "_sure", "count_in_frame"), synonyms)
    m = m.groupBy("scene", "name").agg(F.min("_first").alias("first"), F.min("_sure").alias("sure"), F.max("count_in_frame").alias("n"))
    m = m.groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("first", "sure", "n")))).alias("_names"))
    rows = e.groupBy("scene").agg(F.sort_array(F.collect_list(places)).alias("_places"), F.sort_array(F.collect_list(sizes)).alias("_sizes"))
    return rows.join(m, "scene", "left")


def listed(name: Column) -> Column:
    """What a row's book (scene_book) has of a name: first, sure, n; null where it matches nothing."""
    return F.try_element_at(F.col("_names"), name)


def place_of(name: Column) -> Column:
    """The first entity that a name means (mx, my, mz, first_seen), from a row's book."""
    return F.get(F.col("_places"), listed(name)["first"] - 1)


def attach(rows: DataFrame, name: str, found: DataFrame, as_: str) -> DataFrame:
    """Rows with the match of the name in one of their columns as a struct column, null without a match."""
    f = found.select(F.col("scene").alias("_s"), F.col("name").alias("_n"), F.col("e").alias(as_))
    return rows.join(f, (F.col("scene") == F.col("_s")) & (F.col(name) == F.col("_n")), "left").drop("_s", "_n")


def pairs(entities: DataFrame, most: float | None = None) -> DataFrame:
    """Pairs of a scene's entities in order of first detection with their distance; with a bound, those nearer than that and some more.

    With a bound, places are dealt to cells twice its size: a pair meets in the cell of one of them, since either both share it or the other
    looks into it from one of the 13 cells on one side; it looks only where it is no further than the bound from the border. A row holds the
    places of one cell, and its pairs are made from that row: entities are read once, and pairs stay where their scene is.
    """
    keep = ["scene", "label", "entity_ord", "mx", "my", "mz"]
    e = entities.select(*keep)
    away = lambda c, of: F.col(f"b{of}m{c}") - F.col(f"a{of}m{c}")
    distance = lambda of: F.sqrt(reduce(lambda a, b: a + b, [away(c, of) * away(c, of) for c in "xyz"]))
    if most is None:
        named = lambda p: e.select("scene", *[F.col(c).alias(f"{p}_{c}") for c in keep[1:]])
        out = named("a").join(named("b"), "scene").filter("a_entity_ord < b_entity_ord").withColumn("distance", distance("_"))
    else:
        e = e.filter("scene IS NOT NULL AND mx IS NOT NULL AND my IS NOT NULL AND mz IS NOT NULL").select("*", *[F.floor(F.col(f"m{c}") / (2 * most)).alias(f"_c{c}") for c in "xyz"])
        part = lambda c: F.col(f"m{c}") / (2 * most) - F.col(f"_c{c}")
        near = lambda o: reduce(lambda a, b: a & b, [F.when(o[c] < 0, part(c) <= REACH).when(o[c] > 0, part(c) >= 1 - REACH).otherwise(True) for c in "xyz"])
        own = F.struct(*[F.lit(0).alias(c) for c in "xyz"])
        looks = e.select("*", F.explode(F.concat(F.array(own), F.filter(offsets(half=True), near))).alias("o"))
        looks = looks.select("scene", *[(F.col(f"_c{c}") + F.col(f"o.{c}")).alias(f"_c{c}") for c in "xyz"], F.struct(*keep[1:], (F.col("o") != own).alias("looks")).alias("p"))
        cells = looks.groupBy("scene", "_cx", "_cy", "_cz").agg(F.collect_list("p").alias("a"), F.collect_list(F.when(~F.col("p.looks"), F.col("p"))).alias("b"))
        met = cells.select("scene", "b", F.explode("a").alias("a")).select("scene", "a", F.explode("b").alias("b")).filter("a.looks OR a.entity_ord < b.entity_ord")
        first = F.col("a.entity_ord") < F.col("b.entity_ord")
        out = met.select("scene", *[F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{p}_{c}") for p, q in ("ab", "ba") for c in keep[1:]], distance(".").alias("distance"))
    return out


def nearest_frame(entities: DataFrame, frames: DataFrame) -> DataFrame:
    """As-of join: each entity with the sampled frame nearest to its first one, the earlier of two as near; frames: scene, frame."""
    f = frames.groupBy("scene").agg(F.sort_array(F.collect_set("frame")).alias("_f"))
    near = F.array_min(F.transform("_f", lambda x: F.struct(F.abs(x - F.col("first_seen")).alias("gap"), x.alias("frame"))))
    return entities.join(f, "scene").select("scene", "label", "first_seen", near["frame"].alias("frame"), near["gap"].alias("gap"))


def not_found(names: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """Names that match no entity of their scene."""
    return names.select("scene", "name").distinct().join(all_matches(names, entities, synonyms).select("scene", "name").distinct(), ["scene", "name"], "left_anti")


def evenly(frames, k: int):
    """Of an array's distinct values in order k spread evenly: those at int(i * n / k); all where there are no more than k."""
    f = F.array_sort(F.array_distinct(frames))
    return F.when(F.size(f) <= k, f).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(f, (i * F.size(f) / k).cast("int"))))


def top_in(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")
