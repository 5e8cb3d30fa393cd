"""A scene's bounds, its scale in metres, its grid, and its area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.geometry import grid_cell
from loculus.functions.tables import CALIBRATION_SIZES, COMMON_RANGES, SYNONYMS
from loculus.operators.matching import name_pairs

GRID = 64


def places(entities: DataFrame, cameras: DataFrame) -> DataFrame:
    """scene, x, y, z of entities and cameras, without rows that are not finite."""
    out = entities.select("scene", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z")).unionByName(cameras.select("scene", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")))
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.filter(ok)


def scene_bounds(entities: DataFrame, cameras: DataFrame) -> DataFrame:
    """scene, lo and hi of x, y, z (2nd and 98th percentile, 1 m where they are less than 0.5 apart), raw_mpg (metres per cell of the grid)."""
    p = places(entities, cameras).groupBy("scene").agg(*[F.percentile(c, F.array(F.lit(0.02), F.lit(0.98))).alias(c) for c in "xyz"])
    near = lambda c: F.col(c)[1] - F.col(c)[0] < 0.5
    mid = lambda c: (F.col(c)[1] + F.col(c)[0]) / 2
    out = p.select("scene", *[F.when(near(c), mid(c) - 0.5).otherwise(F.col(c)[0]).alias(f"lo_{c}") for c in "xyz"], *[F.when(near(c), mid(c) + 0.5).otherwise(F.col(c)[1]).alias(f"hi_{c}") for c in "xyz"])
    return out.withColumn("raw_mpg", F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]) / GRID)


def first_rows(entities: DataFrame, table: list[tuple], synonyms=SYNONYMS) -> DataFrame:
    """Each entity with the first row of the table whose name it matches; the table is a constant, a few dozen rows, and meets the labels through an index."""
    spark = entities.sparkSession
    dim = spark.createDataFrame([(k, r[0], float(sum(r[1:]) / (len(r) - 1))) for k, r in enumerate(table)], "dim_ord int, dim_name string, dim_size double")
    meant = name_pairs(dim.select(F.col("dim_name").alias("name")), entities.select("label"), synonyms).withColumnRenamed("name", "dim_name")
    names = meant.join(F.broadcast(dim), "dim_name").groupBy("label").agg(F.min_by(F.struct("dim_name", "dim_size"), "dim_ord").alias("d"))
    return entities.join(names, "label").select("scene", "label", "w3", "h3", F.col("d.dim_name").alias("dim_name"), F.col("d.dim_size").alias("dim_size"))


def scene_scale(entities: DataFrame, bounds: DataFrame, sizes=CALIBRATION_SIZES, ranges=COMMON_RANGES, synonyms=SYNONYMS) -> DataFrame:
    """scene, n_cal, n_common, factor, mpg, scf: the factor from sizes that are known, else usual ones, else the span, drawn towards 10 m or 5 m where the span would be above 25 m or below 3 m."""
    size = F.greatest("w3", "h3")
    by = lambda table, low, high, name: first_rows(entities, table, synonyms).filter(size > 0.001).withColumn("f", F.col("dim_size") / size).filter((F.col("f") > low) & (F.col("f") < high)).groupBy("scene").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.median("f").alias(f"f_{name}"))
    s = bounds.join(by(sizes, 0.01, 1000, "cal"), "scene", "left").join(by(ranges, 0.005, 5000, "common"), "scene", "left")
    raw = F.col("raw_mpg") * GRID
    known = F.coalesce("f_cal", "f_common")
    span = raw * known
    far, close = F.least(F.lit(0.8), (span - 25.0) / 25.0), F.least(F.lit(0.7), (3.0 - span) / 3.0)
    clamped = F.when(span > 25.0, known * (1 - far) + 10.0 / raw * far).when(span < 3.0, known * (1 - close) + 5.0 / raw * close).otherwise(known)
    bare = F.when(raw > 15.0, 7.0 / raw).when(raw < 2.0, 5.0 / raw).otherwise(F.lit(1.0))
    s = s.withColumn("factor", F.when(known.isNull(), bare).otherwise(clamped))
    s = s.withColumn("mpg", F.col("raw_mpg") * F.col("factor"))
    return s.select("scene", "raw_mpg", F.coalesce("n_cal", F.lit(0)).alias("n_cal"), F.coalesce("n_common", F.lit(0)).alias("n_common"), "factor", "mpg", F.when(F.col("raw_mpg") > 1e-8, F.col("mpg") / F.col("raw_mpg")).otherwise(F.lit(1.0)).alias("scf"))


def grid_cells(entities: DataFrame, bounds: DataFrame) -> DataFrame:
    e = entities.join(F.broadcast(bounds), "scene", "left")
    return e.select("scene", "label", *[grid_cell(F.col(f"m{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}"), GRID).alias(f"g{c}") for c in "xyz"])


def room_area(entities: DataFrame, cameras: DataFrame, scale: DataFrame) -> DataFrame:
    """scene, area in square metres: the two greatest extents (5th to 95th percentile from ten places on) in metres, 2 m more each, within 5 and 80."""
    p = places(entities, cameras).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(c) for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"all_{c}") for c in "xyz"])
    ext = F.sort_array(F.array(*[F.when(F.col("n") >= 10, F.col(c)[1] - F.col(c)[0]).otherwise(F.col(f"all_{c}")) * F.col("scf") for c in "xyz"]), asc=False)
    p = p.join(scale.select("scene", "scf"), "scene").withColumn("e", ext)
    return p.select("scene", F.greatest(F.lit(5.0), F.least(F.lit(80.0), (F.col("e")[0] + 2.0) * (F.col("e")[1] + 2.0))).alias("area"))


def stratified_sample(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows of each value of `by`, spread evenly over its rows in order: row floor(i * (count - 1) / (n - 1)) for i below n."""
    w = Window.partitionBy(by)
    r = rows.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_c": F.count(F.lit(1)).over(w)})
    m = F.least(F.col("_c"), F.lit(n))
    step = (F.col("_c") - 1) / F.greatest(m - 1, F.lit(1)).cast("double")
    picks = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when((m > 1) & (i == m - 1), F.col("_c") - 1).otherwise(F.floor(i * step)))
    return r.filter(F.array_contains(picks, F.col("_k"))).drop("_k", "_c")
