"""The boundary to models: tables by default, vectorised functions where a model is plugged in.

Detectors, depth and pose estimators, vision-language models and feature extractors don't run in the engine; it reads what they
gave from tables. A plug-in is a function of a pandas frame; it runs in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLUGINS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def register(name: str, schema: str):
    """Registers a function of a pandas frame under a name, with the schema of what it returns."""

    def add(f: Callable[[pd.DataFrame], pd.DataFrame]):
        PLUGINS[name] = (f, schema)
        return f

    return add


def apply(rows: DataFrame, name: str, table: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Rows through the plug-in of that name; without one, joined with a table of its results."""
    if name in PLUGINS:
        f, schema = PLUGINS[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield f(b)

        return rows.mapInPandas(run, schema)
    if table is None or not on:
        raise LookupError(f"no plug-in named {name} and no table of its results")
    return rows.join(table, on, "left")


def detections_from_boxes(boxes: DataFrame, cameras: DataFrame, depth: DataFrame) -> DataFrame:
    """2-D boxes with depth pixels and cameras as 3-D detections.

    boxes: scene, frame_order, frame_idx, label, confidence, x1, y1, x2, y2 in pixels of the original frame. cameras: scene,
    frame_order, r0 ... r8, t0, t1, t2, fx, fy, cx, cy, proc_w, proc_h, orig_w, orig_h. depth: scene, frame_order, u, v, depth.
    The depth is the median over the box, its deviation over pixels deeper than 0.01 (1 where there are fewer than two); boxes with
    less depth than 0.01 and sub-word labels go. Pixels meet boxes by frame and row, so a box never sees a whole frame.
    """
    from loculus.functions.geometry import pixel_size, pixel_to_world, position_uncertainty

    b = boxes.withColumn("label", F.lower(F.trim("label"))).filter(~F.col("label").startswith("##")).join(cameras, ["scene", "frame_order"])
    b = b.withColumns({c: F.col(c) * F.col(f"proc_{d}") / F.col(f"orig_{d}") for c, d in (("x1", "w"), ("x2", "w"), ("y1", "h"), ("y2", "h"))})
    clip = lambda c, d: F.greatest(F.lit(0), F.least(F.col(c), F.col(f"proc_{d}") - 1)).cast("int")
    b = b.withColumn("box", F.row_number().over(Window.partitionBy("scene", "frame_order").orderBy(F.desc("confidence"), "label", "x1", "y1", "x2", "y2")))
    rows = b.select("scene", "frame_order", "box", clip("x1", "w").alias("u1"), clip("x2", "w").alias("u2"), F.explode(F.sequence(clip("y1", "h"), clip("y2", "h"))).alias("v"))
    inside = rows.join(depth, ["scene", "frame_order", "v"]).filter("u BETWEEN u1 AND u2")
    d = inside.groupBy("scene", "frame_order", "box").agg(F.median("depth").alias("depth"), F.count_if(F.col("depth") > 0.01).alias("n"), F.stddev_pop(F.when(F.col("depth") > 0.01, F.col("depth"))).alias("s"))
    b = b.join(d, ["scene", "frame_order", "box"]).filter("depth >= 0.01").withColumn("depth_std", F.when(F.col("n") > 1, F.col("s")).otherwise(F.lit(1.0)))
    r, t = [F.col(f"r{k}") for k in range(9)], tuple(F.col(f"t{k}") for k in range(3))
    x, y, z = pixel_to_world((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("depth"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), r, t)
    w, h = pixel_size(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("depth"), F.col("fx"), F.col("fy"))
    return b.select("scene", "label", "frame_idx", "frame_order", "confidence", x.alias("x"), y.alias("y"), z.alias("z"), w.alias("width_3d"), h.alias("height_3d"), F.col("depth").alias("depth_value"), "depth_std", position_uncertainty(F.col("depth_std"), F.col("confidence")).alias("position_uncertainty"), F.col("box").alias("det_ord"))
