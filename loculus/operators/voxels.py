"""Voxel maps: fusion, fillings, areas, rays and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.functions.geometry import voxel_center, voxel_floor, voxel_trunc
from loculus.session import ensure_checkpoint_dir

KEY = ("scene", "vx", "vy", "vz")


def fuse(points: DataFrame, size: float) -> DataFrame:
    """Points as voxels: hits, occupancy min(1, 0.6 + 0.1 hits), mean colour, first and last frame."""
    return points.groupBy("scene", *[voxel_floor(F.col(c), size).alias(f"v{c}") for c in "xyz"]).agg(F.count(F.lit(1)).alias("hits"), F.least(F.lit(1.0), 0.6 + 0.1 * F.count(F.lit(1))).alias("occupancy"), *[F.avg(c).alias(c) for c in "rgb"], F.min("frame_order").alias("first_frame"), F.max("frame_order").alias("last_frame"))


def downsample(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy("scene", *[voxel_floor(F.col(c), size).alias(f"v{c}") for c in "xyz"]).agg(*[F.avg(c).alias(c) for c in "xyzrgb"])


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("scene").agg(*[F.min(c).alias(f"min_{c}") for c in "xyz"], *[F.max(c).alias(f"max_{c}") for c in "xyz"], *[F.avg(c).alias(f"mid_{c}") for c in "xyz"])


def transform(points: DataFrame, r: list[float], t: list[float]) -> DataFrame:
    """Points moved by a rotation (nine numbers, row by row) and a shift."""
    move = {c: r[3 * k] * F.col("x") + r[3 * k + 1] * F.col("y") + r[3 * k + 2] * F.col("z") + t[k] for k, c in enumerate("xyz")}
    return points.withColumns(move)


def merge(clouds: list[tuple[DataFrame, list[float], list[float]]], size: float) -> DataFrame:
    """Clouds moved into one place and thinned."""
    out = None
    for p, r, t in clouds:
        p = transform(p, r, t)
        out = p if out is None else out.unionByName(p)
    return downsample(out, size)


def centers(voxels: DataFrame, size: float) -> DataFrame:
    return voxels.withColumns({c: voxel_center(F.col(f"v{c}"), size) for c in "xyz"})


def occupied(voxels: DataFrame, least: float = 0.5) -> DataFrame:
    return voxels.filter(F.col("occupancy") >= least)


def near_place(voxels: DataFrame, places: DataFrame, radius: float, size: float) -> DataFrame:
    """Voxels whose centre is within the radius of a place; places: scene, place, x, y, z. The cell ranges come before the distance."""
    p = places.select("scene", "place", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    reach = int(-(-radius // size))
    v = centers(voxels, size).join(p, "scene")
    box, d = F.lit(True), F.lit(0.0)
    for c in "xyz":
        box = box & (F.abs(F.col(f"v{c}") - voxel_floor(F.col(f"p{c}"), size)) <= reach)
        d = d + (F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}"))
    return v.filter(box & (F.sqrt(d) <= radius)).select("scene", "place", "vx", "vy", "vz", F.sqrt(d).alias("distance"))


#: Voxels along x of a slab, the part of a scene whose boxes are filled in one task.
SLAB = 16


def fill_boxes(det: DataFrame, size: float, depth: Column | None = None) -> DataFrame:
    """Voxels that detections' boxes cover: mean confidence as occupancy, label of the last sure detection (over 0.5), else of the first.

    Boxes are sent to the slabs that they reach into, and become voxels there: a box fills far more voxels than it meets slabs.
    """
    depth = F.lit(0.3) if depth is None else depth
    out = det.select("scene", "label", "confidence", "det_ord", "x", "y", "z", F.col("width_3d").alias("ex"), F.col("height_3d").alias("ey"), depth.alias("ez"))
    low, high = ({c: voxel_floor(F.col(c) + s * F.col(f"e{c}") / 2, size) for c in "xyz"} for s in (-1, 1))
    ends = [F.struct(low[c].alias("a"), high[c].alias("b")).alias(c) for c in "xyz"]
    out = out.select("scene", "label", "confidence", "det_ord", *ends)
    out = out.withColumn("slab", F.explode(F.sequence(F.floor(F.col("x.a") / SLAB), F.floor(F.col("x.b") / SLAB)))).repartition("scene", "slab")
    first, last = F.greatest(F.col("x.a"), F.col("slab") * SLAB), F.least(F.col("x.b"), F.col("slab") * SLAB + SLAB - 1)
    out = out.withColumn("vx", F.explode(F.sequence(first, last).cast("array<int>"))).withColumns({f"v{c}": F.explode(F.sequence(F.col(f"{c}.a"), F.col(f"{c}.b"))) for c in "y"})
    out = out.withColumn("vz", F.explode(F.sequence(F.col("z.a"), F.col("z.b"))))
    sure = F.col("confidence") > 0.5
    return out.groupBy("scene", "slab", "vx", "vy", "vz").agg(F.avg("confidence").alias("occupancy"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by("label", F.when(sure, F.col("det_ord"))), F.min_by("label", "det_ord")).alias("label")).drop("slab")


def half_open_boxes(entities: DataFrame, size: float, depth: Column | None = None) -> DataFrame:
    """The median family's filling: steps of a voxel from the low to below the high side, cut towards zero."""
    out = entities.select("scene", "mx", "my", "mz", F.col("w3").alias("ex"), F.col("h3").alias("ey"), (F.lit(0.3) if depth is None else depth).alias("ez")).filter("ex > 0 AND ey > 0 AND ez > 0")
    for c in "xyz":
        low = F.col(f"m{c}") - F.col(f"e{c}") / 2
        steps = F.ceil(F.col(f"e{c}") / size).cast("int")
        out = out.withColumn(f"v{c}", F.explode(F.transform(F.sequence(F.lit(0), steps - 1), lambda i: voxel_trunc(low + i * size, size))))  # noqa: B023
    return out.select(*KEY).distinct()


def areas(voxels: DataFrame, size: float, least: float = 0.3) -> DataFrame:
    """scene, volume, floor_area (distinct columns of voxels), width, height, depth with margins."""
    v = voxels.filter(F.col("occupancy") >= least)
    d = {c: (F.max(f"v{c}") - F.min(f"v{c}") + 1) * size for c in "xyz"}
    return v.groupBy("scene").agg((F.count(F.lit(1)) * size**3).alias("volume"), (F.countDistinct("vx", "vz") * size**2).alias("floor_area"), (d["x"] + 1.0).alias("width"), (d["y"] + 0.5).alias("height"), (d["z"] + 1.0).alias("depth"))


def box_area(entities: DataFrame) -> DataFrame:
    """scene, area of the box around entities in the XZ plane."""
    return entities.groupBy("scene").agg(((F.max("mx") - F.min("mx")) * (F.max("mz") - F.min("mz"))).alias("area"))


def first_hits(rays: DataFrame, voxels: DataFrame, size: float, least: float = 0.5) -> DataFrame:
    """Where each ray first meets a voxel above `least`; rays: ray, scene, o and d (unit) of x, y, z, reach. Steps of half a voxel are dealt out and met with the voxels by key."""
    step = size / 2
    n = F.ceil(F.col("reach") / step).cast("int")
    s = rays.filter(n > 0).select("ray", "scene", "ox", "oy", "oz", "dx", "dy", "dz", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    s = s.withColumn("t", F.col("i") * step).withColumns({f"v{c}": voxel_floor(F.col(f"o{c}") + F.col(f"d{c}") * F.col("i") * step, size) for c in "xyz"})
    hit = s.join(voxels.filter(F.col("occupancy") > least).select(*KEY, "label"), list(KEY))
    return hit.groupBy("ray").agg(F.min("t").alias("t"), F.min_by("label", "t").alias("label"))


def components(voxels: DataFrame, least_cosine: float = 0.5) -> DataFrame:
    """scene, vx, vy, vz, component: voxels joined through faces where the colours' cosine is `least_cosine` or more (or a colour has no length).

    A component is named by its least voxel, as "x,y,z"; coordinates have no bounds. In each round each voxel goes to the neighbour, or
    stays, whose hash of the round is least; voxels that meet become one and what is left of the edges shrinks by a share, so rounds grow
    with the logarithm of a map's size. Rounds are written to the checkpoint folder.
    """
    ensure_checkpoint_dir(voxels.sparkSession)
    v = voxels.select(*KEY, "r", "g", "b", F.struct("vx", "vy", "vz").alias("id"))
    length = lambda p: F.sqrt(F.col(f"{p}r") * F.col(f"{p}r") + F.col(f"{p}g") * F.col(f"{p}g") + F.col(f"{p}b") * F.col(f"{p}b"))
    other = v.select(*KEY, F.col("id").alias("id2"), *[F.col(c).alias(f"o{c}") for c in "rgb"])
    faces = F.array(*[F.struct(*[F.lit(int(c == f)).alias(c) for c in "xyz"]) for f in "xyz"])
    ahead = v.select("scene", "id", "r", "g", "b", F.explode(faces).alias("d")).select("scene", *[(F.col(f"id.v{c}") + F.col(f"d.{c}")).alias(f"v{c}") for c in "xyz"], "id", "r", "g", "b")
    close = (F.col("r") * F.col("or") + F.col("g") * F.col("og") + F.col("b") * F.col("ob")) >= least_cosine * length("") * length("o")
    edges = ahead.join(other, list(KEY)).filter(close).select("scene", F.col("id").alias("a"), F.col("id2").alias("b")).checkpoint()
    found, k = None, 0
    while not edges.isEmpty():
        mark = lambda c: F.struct(F.xxhash64("scene", c, F.lit(k)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = edges.select("scene", F.col("a").alias("id"), mark("b").alias("x")).unionByName(edges.select("scene", F.col("b").alias("id"), mark("a").alias("x")))
        step = ends.groupBy("scene", "id").agg(F.min("x").alias("x")).select("scene", "id", F.least("x", mark("id"))["to"].alias("to")).checkpoint()
        if found is None:
            found = step
        else:
            found = found.withColumnRenamed("to", "was").join(step.withColumnRenamed("id", "was"), ["scene", "was"], "left").select("scene", "id", F.coalesce("to", "was").alias("to"))
        a, b = step.select("scene", F.col("id").alias("a"), F.col("to").alias("ta")), step.select("scene", F.col("id").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(a, ["scene", "a"]).join(b, ["scene", "b"]).filter("ta <> tb").select("scene", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct().checkpoint()
        k += 1
    name = lambda c: F.concat_ws(",", f"{c}.vx", f"{c}.vy", f"{c}.vz")
    if found is None:
        return v.select(*KEY, name("id").alias("component"))
    least = found.groupBy("scene", "to").agg(F.min("id").alias("least"))
    names = found.join(least, ["scene", "to"]).select("scene", "id", "least")
    return v.join(names, ["scene", "id"], "left").select(*KEY, F.coalesce("least", "id").alias("least")).select(*KEY, name("least").alias("component"))


def component_entities(voxels: DataFrame, parts: DataFrame, size: float, least: int = 10) -> DataFrame:
    """Components of `least` voxels or more as entities: count, centroid, box, mean colour, first and last frame."""
    v = centers(voxels, size).join(parts, list(KEY))
    return v.groupBy("scene", "component").agg(F.count(F.lit(1)).alias("n_voxels"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"], *[F.avg(c).alias(c) for c in "rgb"], F.min("first_frame").alias("first_seen"), F.max("last_frame").alias("last_seen")).filter(F.col("n_voxels") >= least)


def letter_map(voxels: DataFrame, resolution: float = 0.5, most: int = 30) -> DataFrame:
    """A scene from above as lines of text: a cell has the first letter of what stands there last, else a dot."""
    b = voxels.groupBy("scene").agg(F.min("vx").alias("x0"), F.min("vz").alias("z0"), F.max("vx").alias("x1"), F.max("vz").alias("z1"))
    v = voxels.join(b, "scene").select("scene", (F.col("vx") - F.col("x0")).alias("cx"), (F.col("vz") - F.col("z0")).alias("cz"), "label").filter((F.col("cx") < most) & (F.col("cz") < most))
    cell = v.groupBy("scene", "cz", "cx").agg(F.upper(F.substring(F.max("label"), 1, 1)).alias("c"))
    rows = cell.groupBy("scene", "cz").agg(F.map_from_entries(F.collect_list(F.struct("cx", "c"))).alias("m")).join(b, "scene")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(most - 1), F.col("x1") - F.col("x0"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("."))), "")
    return rows.select("scene", "cz", line.alias("line"))


def navigable(voxels: DataFrame, low: DataFrame, size: float, resolution: float = 0.3, most: int = 50) -> DataFrame:
    """Cells that are blocked: scene, gx, gz; low: scene, min_x, min_z."""
    v = voxels.filter("occupancy > 0.3").join(low, "scene")
    g = lambda c: ((F.col(f"v{c}") * size - F.col(f"min_{c}")) / resolution).cast("int") + 1
    return v.select("scene", g("x").alias("gx"), g("z").alias("gz")).filter(f"gx >= 0 AND gz >= 0 AND gx < {most} AND gz < {most}").distinct()
