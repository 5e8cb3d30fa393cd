"""Places and boxes of a scene through grids whose cells suit its size: nearest others, rays against boxes, boxes that meet."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.session import ensure_checkpoint_dir

#: In cells: boxes are listed this much wider than they are, so that rounding at a border loses none.
MARGIN = 1e-6
AXES = "xyz"


def offsets(half: bool = False) -> Column:
    """The 27 offsets of a cell and those around it as an array of structs; half: of each two opposite ones the one that comes first, and none for the cell itself."""
    some = [o for o in product((-1, 0, 1), repeat=3) if not half or o > (0, 0, 0)]
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(AXES, o)]) for o in some])


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def nearest_other(entities: DataFrame) -> DataFrame:
    """scene, label, nearest, nearest_distance: of each entity the nearest other of its scene, of equals (to nine decimals) the first detected; nulls where it is alone.

    A scene's cells hold about one entity each at first. An entity looks at its cell and the 26 around it; it is done if what it finds
    is no further than a cell is wide, since all else is further. The others go on with cells twice as wide, until a cell holds the scene.
    What is left shrinks by rounds, whose number grows with the logarithm of the cells across a scene. Rounds are cut by checkpoints.
    """
    ensure_checkpoint_dir(entities.sparkSession)
    places = entities.select("scene", "label", "entity_ord", *[F.col(f"m{c}").alias(c) for c in AXES])
    spans = places.groupBy("scene").agg(F.greatest(*[F.max(c) - F.min(c) for c in AXES]).alias("span"), F.count(F.lit(1)).alias("n"))
    spans = spans.select("scene", "span", F.greatest(F.col("span") / F.ceil(F.cbrt("n")), F.lit(1e-6)).alias("size"))
    places = places.join(spans, "scene").checkpoint()
    left, done, wide = places, [], 1.0
    while True:
        size = F.col("size") * wide
        cells = places.select("scene", F.col("label").alias("_label"), F.col("entity_ord").alias("_ord"), *[F.col(c).alias(f"_{c}") for c in AXES], *[F.floor(F.col(c) / size).alias(f"c{c}") for c in AXES])
        looks = left.select("*", F.explode(offsets()).alias("_o")).select("scene", "entity_ord", *AXES, *[(F.floor(F.col(c) / size) + F.col(f"_o.{c}")).alias(f"c{c}") for c in AXES])
        away = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"_{c}") - F.col(c)) * (F.col(f"_{c}") - F.col(c)) for c in AXES]))
        met = looks.join(cells, ["scene", *[f"c{c}" for c in AXES]]).filter("entity_ord <> _ord").withColumn("_d", away)
        best = met.groupBy("scene", "entity_ord").agg(F.min_by(F.struct("_label", "_d"), F.struct(F.round("_d", 9).alias("d"), "_ord")).alias("best"))
        found = left.join(best, ["scene", "entity_ord"], "left").withColumn("_done", F.coalesce(F.col("best._d") <= size, F.lit(False)) | (size >= F.col("span"))).checkpoint()
        done.append(found.filter("_done").select("scene", "label", F.col("best._label").alias("nearest"), F.col("best._d").alias("nearest_distance")))
        left, wide = found.filter("NOT _done").drop("best", "_done"), wide * 2
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)


def box_grid(boxes: DataFrame) -> DataFrame:
    """scene, size, and o and e of x, y, z: where a scene's boxes begin and end, and the width of cells that hold about one box each; boxes: scene, lo_ and hi_ of x, y, z."""
    spans = boxes.groupBy("scene").agg(*[F.min(f"lo_{c}").alias(f"_o{c}") for c in AXES], *[F.max(f"hi_{c}").alias(f"_e{c}") for c in AXES], F.count(F.lit(1)).alias("n"), F.avg(F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in AXES])).alias("mean"))
    span = F.greatest(*[F.col(f"_e{c}") - F.col(f"_o{c}") for c in AXES])
    return spans.select("scene", *[f"_o{c}" for c in AXES], *[f"_e{c}" for c in AXES], F.greatest(span / F.ceil(F.cbrt("n")), "mean", F.lit(1e-6)).alias("_size"))


def box_cells(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """Each box in all cells that it reaches into: cx, cy, cz added."""
    out = boxes.join(grid, "scene")
    for c in AXES:
        low, high = ((F.col(f"{p}_{c}") - F.col(f"_o{c}")) / F.col("_size") for p in ("lo", "hi"))
        out = out.withColumn(f"c{c}", F.explode(F.sequence(F.floor(low - MARGIN), F.floor(high + MARGIN))))
    return out.drop("_size", *[f"_{p}{c}" for p in "oe" for c in AXES])


def slabs(low: dict[str, Column], high: dict[str, Column]) -> tuple[Column, Column]:
    """Where a ray (o and d of x, y, z) enters and leaves a box; it misses where the first is greater."""
    near, far = [], []
    for c in AXES:
        a, b = F.try_divide(low[c] - F.col(f"o{c}"), F.col(f"d{c}")), F.try_divide(high[c] - F.col(f"o{c}"), F.col(f"d{c}"))
        inside, flat = F.col(f"o{c}").between(low[c], high[c]), F.col(f"d{c}") == 0
        near.append(F.when(flat, F.when(inside, F.lit(-1e308)).otherwise(F.lit(1e308))).otherwise(F.least(a, b)))
        far.append(F.when(flat, F.when(inside, F.lit(1e308)).otherwise(F.lit(-1e308))).otherwise(F.greatest(a, b)))
    return F.greatest(*near), F.least(*far)


def ray_cells(rays: DataFrame, grid: DataFrame) -> DataFrame:
    """Each ray in the cells that it passes through between its scene's first and last box: cx, cy, cz added.

    A ray changes cells where it crosses a plane between two; between two crossings that follow each other it is in the cell of their middle.
    """
    pad = F.col("_size") * MARGIN
    t0, t1 = slabs({c: F.col(f"_o{c}") - pad for c in AXES}, {c: F.col(f"_e{c}") + pad for c in AXES})
    out = rays.join(grid, "scene").withColumn("_t0", F.greatest(t0, F.lit(0.0))).withColumn("_t1", t1).filter("_t0 <= _t1")
    at = lambda c, t: (F.col(f"o{c}") + F.col(f"d{c}") * t - F.col(f"_o{c}")) / F.col("_size")

    def crossings(c: str) -> Column:
        a, b = at(c, F.col("_t0")), at(c, F.col("_t1"))
        low, high = F.floor(F.least(a, b)) + 1, F.floor(F.greatest(a, b))
        plane = lambda k: F.try_divide(F.col(f"_o{c}") + k * F.col("_size") - F.col(f"o{c}"), F.col(f"d{c}"))
        return F.when((F.col(f"d{c}") != 0) & (low <= high), F.transform(F.sequence(low, F.greatest(low, high)), plane)).otherwise(F.array().cast("array<double>"))

    turns = F.concat(F.array("_t0"), F.array_sort(F.concat(*[crossings(c) for c in AXES])), F.array("_t1"))
    out = out.withColumn("_t", turns)
    middles = F.transform(F.sequence(F.lit(0), F.size("_t") - 2), lambda i: (F.get("_t", i) + F.get("_t", i + 1)) / 2)
    out = out.select(*rays.columns, "_size", *[f"_o{c}" for c in AXES], F.explode(middles).alias("_m"))
    return out.select(*rays.columns, *[F.floor(at(c, F.col("_m"))).alias(f"c{c}") for c in AXES])


def ray_candidates(rays: DataFrame, boxes: DataFrame) -> DataFrame:
    """The rays with the boxes of the cells that they pass through, a row for each such cell: all that need a test."""
    grid = box_grid(boxes)
    return ray_cells(rays, grid).join(box_cells(boxes, grid), ["scene", *[f"c{c}" for c in AXES]])


def box_hits(rays: DataFrame, boxes: DataFrame) -> DataFrame:
    """The first box of its scene that each ray meets: ray, box, t; of equally far ones (to nine decimals) the least by name.

    rays: ray, scene, o and d of x, y, z; boxes: scene, box, lo_ and hi_ of x, y, z. A ray is tested with the boxes of the cells that it
    passes through.
    """
    t0, t1 = slabs({c: F.col(f"lo_{c}") for c in AXES}, {c: F.col(f"hi_{c}") for c in AXES})
    hit = ray_candidates(rays, boxes).withColumn("t", F.when((t0 <= t1) & (t1 >= 0), F.greatest(t0, F.lit(0.0)))).filter("t IS NOT NULL")
    return hit.groupBy("ray").agg(F.min("t").alias("t"), F.min_by("box", F.struct(F.round("t", 9).alias("t"), "box")).alias("box"))


def boxes_that_meet(boxes: DataFrame) -> DataFrame:
    """scene, a, b: pairs of boxes (scene, box, ord, lo_ and hi_ of x, y, z) that touch, a before b by ord; a pair meets in one cell, where both of them are first."""
    grid = box_grid(boxes)
    cells = box_cells(boxes, grid).join(grid, "scene")
    lowest = _all([F.col(f"c{c}") == F.floor((F.greatest(f"a_lo_{c}", f"b_lo_{c}") - F.col(f"_o{c}")) / F.col("_size") - MARGIN) for c in AXES])
    side = lambda p: cells.select("scene", *[f"c{c}" for c in AXES], *[F.col(c).alias(f"{p}_{c}") for c in ("box", "ord", *[f"{e}_{c}" for c in AXES for e in ("lo", "hi")])], *([*[f"_o{c}" for c in AXES], "_size"] if p == "a" else []))
    met = side("a").join(side("b"), ["scene", *[f"c{c}" for c in AXES]]).filter("a_ord < b_ord").filter(lowest)
    return met.filter(_all([(F.col(f"a_lo_{c}") <= F.col(f"b_hi_{c}")) & (F.col(f"a_hi_{c}") >= F.col(f"b_lo_{c}")) for c in AXES])).select("scene", F.col("a_box").alias("a"), F.col("b_box").alias("b"))


def later_but_nearer(entities: DataFrame, depth: float = 1.0, frames: int = 5) -> DataFrame:
    """scene, near, far: pairs of which the first is over `depth` nearer (mz) and yet first seen over `frames` later.

    Depths are parted into about sqrt(n) strips a scene, each with its earliest first frame: an entity meets the strips that are deep
    enough and have one early enough, and then their entities.
    """
    e = entities.select("scene", "label", "mz", "first_seen")
    spans = e.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.min("mz").alias("low"), F.max("mz").alias("high"))
    width = spans.select("scene", F.greatest((F.col("high") - F.col("low")) / F.ceil(F.sqrt("n")), F.lit(1e-6)).alias("width"))
    e = e.join(width, "scene").withColumn("strip", F.floor(F.col("mz") / F.col("width")))
    strips = e.groupBy("scene", "strip").agg(F.min("first_seen").alias("earliest"))
    near = e.select("scene", F.col("label").alias("near"), F.col("mz").alias("na"), F.col("first_seen").alias("fa"), F.floor((F.col("mz") + depth) / F.col("width") - MARGIN).alias("from"))
    far = e.select("scene", "strip", F.col("label").alias("far"), F.col("mz").alias("nb"), F.col("first_seen").alias("fb"))
    ahead = near.join(strips, "scene").filter((F.col("strip") >= F.col("from")) & (F.col("fa") > F.col("earliest") + frames)).drop("earliest", "from")
    return ahead.join(far, ["scene", "strip"]).filter((F.col("na") < F.col("nb") - depth) & (F.col("fa") > F.col("fb") + frames)).select("scene", "near", "far")
