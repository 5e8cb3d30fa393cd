"""Ordered values: smoothing, gaps, turns and bounded histories. A series is named by `by` and ordered by `order`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(rows: DataFrame, by: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential mean of each row and all before it. It is recursive, so each series is folded in order."""
    packed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("s"))
    folded = F.aggregate("s", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x["_v"]).otherwise(alpha * x["_v"] + (1 - alpha) * F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0))))))
    return packed.withColumn("e", folded).select(by, F.explode(F.arrays_zip("s", "e")).alias("z")).select(by, *[F.col(f"z.s.{c}").alias(c) for c in order], F.col("z.e").alias("ema"))


def gaussian(rows: DataFrame, by: str, order: list[str], value: str, size: int = 5) -> DataFrame:
    """A Gaussian kernel of `size` taps and deviation size/6; beyond a series' ends there are zeros."""
    sigma, half = size / 6.0, size // 2
    k = [math.exp(-((i - half) ** 2) / (2 * sigma**2)) for i in range(size)]
    w = Window.partitionBy(by).orderBy(*order)
    tap = lambda i: F.lag(value, -i).over(w) if i <= 0 else F.lead(value, i).over(w)
    out = sum((F.coalesce(tap(i - half), F.lit(0.0)) * (k[i] / sum(k)) for i in range(1, size)), F.coalesce(tap(-half), F.lit(0.0)) * (k[0] / sum(k)))
    return rows.withColumn("smooth", out)


def bilateral(rows: DataFrame, by: str, order: list[str], value: str, sigma_space: float = 2.0, sigma_value: float = 0.1) -> DataFrame:
    """Five neighbours weighed by distance in order and in value; beyond a series' ends its end values stand."""
    w = Window.partitionBy(by).orderBy(*order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(all_), F.last(value).over(all_)
    rows = rows.withColumns({f"_t{i + 2}": F.coalesce(F.lag(value, -i).over(w), first) if i < 0 else F.coalesce(F.lead(value, i).over(w), last) for i in range(-2, 3)})
    weight = lambda i: F.exp(-((F.col("_t2") - F.col(f"_t{i}")) * (F.col("_t2") - F.col(f"_t{i}"))) / (2 * sigma_value**2)) * math.exp(-((i - 2) ** 2) / (2 * sigma_space**2))
    top = sum((weight(i) * F.col(f"_t{i}") for i in range(1, 5)), weight(0) * F.col("_t0"))
    return rows.withColumn("smooth", top / (sum((weight(i) for i in range(1, 5)), weight(0)) + 1e-6)).drop(*[f"_t{i}" for i in range(5)])


def normalised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("norm", (F.col(value) - low) / F.greatest(high - low, F.lit(1e-6)))


def differences(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    return rows.withColumn("diff", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order))))


def last_median(rows: DataFrame, by: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """The median of the last n values that aren't null, at each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.filter(F.col(value).isNotNull())
    recent = F.sort_array(F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)))
    m = F.size(recent)
    return kept.withColumn("median", (F.get(recent, F.floor((m - 1) / 2).cast("int")) + F.get(recent, F.floor(m / 2).cast("int"))) / 2)


def gaps(det: DataFrame) -> DataFrame:
    """Per label: first frame with a detection surer than 0.4 (else the first), mean and greatest gap, continuity 1 or 0.5."""
    f = det.groupBy("scene", "label", "frame_idx").agg(F.max("confidence").alias("c"))
    f = f.withColumn("gap", F.lead("frame_idx").over(Window.partitionBy("scene", "label").orderBy("frame_idx")) - F.col("frame_idx"))
    out = f.groupBy("scene", "label").agg(F.coalesce(F.min(F.when(F.round("c", 9) > 0.4, F.col("frame_idx"))), F.min("frame_idx")).alias("first_sure"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    return out.withColumn("continuity", F.when(F.col("max_gap") < F.col("mean_gap") * 3, 1.0).otherwise(0.5))


def turns(places: DataFrame, by: str, order: list[str]) -> DataFrame:
    """At each inner place of a path in the XZ plane: go forward, turn left or turn right, by the change of heading (30 degrees)."""
    w = Window.partitionBy(by).orderBy(*order)
    d = lambda c, a: (F.col(c) - F.lag(c).over(w)) if a < 0 else (F.lead(c).over(w) - F.col(c))
    turn = (F.atan2(d("z", 1), d("x", 1)) - F.atan2(d("z", -1), d("x", -1))) * 180 / math.pi
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    return places.withColumn("angle", turn).filter("angle IS NOT NULL").withColumn("turn", F.when(F.abs("angle") < 30, "go forward").when(F.col("angle") > 0, "turn left").otherwise("turn right"))


def softmax_choice(logits: Column) -> tuple[Column, Column]:
    """The letter of the greatest of an array of logits, the first of equals, and its probability."""
    top = F.array_max(logits)
    p = 1 / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), F.array_position(logits, top).cast("int")), p
