"""Entity beliefs: detections of one label in one scene summed up as one entity, in several families of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.geometry import mahalanobis

COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def weight() -> Column:
    """Confidence over squared uncertainty, which counts as 1e-4 at least."""
    u = F.greatest(F.coalesce(F.col("position_uncertainty"), F.lit(1.0)), F.lit(1e-4))
    return F.coalesce(F.col("confidence"), F.lit(0.5)) / (u * u)


def entity_beliefs(det: DataFrame, keys: tuple[str, ...] = ("scene", "label")) -> DataFrame:
    """One row for each label of a scene: weighted mean and covariance, confidence, counts, frames, first frame, size.

    Two aggregations with partial sums: by frame, then by label. Covariances are sums of weighted products about zero less the
    mean's product, so no second pass over the detections is needed. entity_ord numbers a scene's entities by first detection.
    """
    w = weight()
    pair = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    frames = det.groupBy(*keys, "frame_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf"), F.sum("depth_std").alias("dstd"), F.min("det_ord").alias("first_ord"), F.sum(w).alias("w"),
        *[F.sum(w * F.col(c)).alias(f"w{c}") for c in "xyz"], *[F.sum(w * F.col(a) * F.col(b)).alias(f"w{a}{b}") for a, b in pair],
        F.max(F.struct("confidence", (-F.col("det_ord")).alias("o"), "width_3d", "height_3d")).alias("best"),
    )
    out = frames.groupBy(*keys).agg(
        F.sum("n").alias("obs_count"), F.sum("conf").alias("conf"), F.sum("dstd").alias("dstd"), F.min("first_ord").alias("first_ord"), F.sum("w").alias("w"),
        *[F.sum(f"w{c}").alias(f"w{c}") for c in "xyz"], *[F.sum(f"w{a}{b}").alias(f"w{a}{b}") for a, b in pair], F.max("best").alias("best"),
        F.greatest(F.lit(1), F.percentile("n", F.lit(0.5)).cast("int")).alias("count_in_frame"), F.max("n").alias("max_in_frame"),
        F.sort_array(F.collect_list(F.struct("frame_idx", (F.col("conf") / F.col("n")).alias("conf")))).alias("frames"),
    )
    mean = {c: F.col(f"w{c}") / F.col("w") for c in "xyz"}
    out = out.select(
        *keys, F.replace(F.col(keys[-1]), F.lit(" "), F.lit("_")).alias("entity_id"), "first_ord", *[mean[c].alias(f"m{c}") for c in "xyz"],
        *[(F.col(f"w{a}{b}") / F.col("w") - mean[a] * mean[b]).alias(n) for n, (a, b) in zip(COV, pair)],
        (F.col("conf") / F.col("obs_count")).alias("confidence"), (F.col("dstd") / F.col("obs_count")).alias("depth_std_mean"), "obs_count", "count_in_frame", "max_in_frame",
        F.transform("frames", lambda f: f["frame_idx"]).alias("support_frames"), F.map_from_entries("frames").alias("frame_confidences"), F.col("frames")[0]["frame_idx"].alias("first_seen"),
        F.col("best.width_3d").alias("w3"), F.col("best.height_3d").alias("h3"), F.lit(0.3).alias("d3"),
    )
    out = out.withColumn("position_uncertainty", F.sqrt(F.greatest(F.col("cxx") + F.col("cyy") + F.col("czz"), F.lit(0.0))))
    return out.filter(~F.isnan("mx") & ~F.isnan("my") & ~F.isnan("mz")).withColumn("entity_ord", F.row_number().over(Window.partitionBy(keys[0]).orderBy("first_ord")))


def median_entities(det: DataFrame) -> DataFrame:
    """The median family: medians of place and size, the greatest count in a frame."""
    frames = det.groupBy("scene", "label", "frame_idx").agg(F.count(F.lit(1)).alias("n")).groupBy("scene", "label").agg(F.max("n").alias("max_count"))
    own = det.groupBy("scene", "label").agg(*[F.median(c).alias(f"m{c}") for c in "xyz"], F.median("width_3d").alias("w3"), F.median("height_3d").alias("h3"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("obs_count"), F.min("frame_idx").alias("first_seen"), F.max("frame_idx").alias("last_seen"))
    return own.join(frames, ["scene", "label"])


def best_size_entities(det: DataFrame) -> DataFrame:
    """Median place, and the size of the detection that is surest."""
    return det.groupBy("scene", "label").agg(*[F.median(c).alias(f"m{c}") for c in "xyz"], F.max_by(F.struct("width_3d", "height_3d"), F.struct("confidence", -F.col("det_ord"))).alias("s"), F.avg("confidence").alias("confidence"), F.min("frame_idx").alias("first_seen")).select("scene", "label", "mx", "my", "mz", F.col("s.width_3d").alias("w3"), F.col("s.height_3d").alias("h3"), "confidence", "first_seen")


def kalman_entities(det: DataFrame, *more: Column) -> DataFrame:
    """The filtered family. With isotropic noise a filter's end state is a weighted mean, whatever the order: plain sums. more: further aggregates of an entity's detections."""
    u = F.col("position_uncertainty")
    p = 1 / (u * u)
    out = det.groupBy("scene", "label").agg(F.sum(p).alias("p"), *[(F.sum(p * F.col(c)) / F.sum(p)).alias(f"m{c}") for c in "xyz"], F.count(F.lit(1)).alias("obs_count"), F.avg("confidence").alias("confidence"), F.min("det_ord").alias("first_ord"), F.min("frame_idx").alias("first_seen"), F.max("frame_idx").alias("last_seen"), *more)
    out = out.withColumn("sigma", F.sqrt(3 / F.col("p"))).withColumn("position_confidence", 1 / (1 + F.col("sigma")))
    return out.withColumn("entity_ord", F.row_number().over(Window.partitionBy("scene").orderBy("first_ord"))).drop("p")


def most_in_frame(frames: Column) -> Column:
    """How often the commonest of an array of frames is there."""
    run = lambda a, x: F.when(a["f"].eqNullSafe(x), a["n"] + 1).otherwise(F.lit(1).cast("long"))
    step = lambda a, x: F.struct(x.alias("f"), run(a, x).alias("n"), F.greatest(a["most"], run(a, x)).alias("most"))
    start = F.struct(F.get(frames, F.lit(-1)).alias("f"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"))
    return F.aggregate(F.sort_array(frames), start, step, lambda a: a["most"])


def size_folds(rows: Column) -> dict[str, Column]:
    """w_mean, w_std, h_mean, h_std of an array of (det_ord, width_3d, height_3d): each step weighs by the final count, so the order counts."""
    d = F.sort_array(rows)
    n = F.size(rows).cast("double")
    step = lambda c: F.aggregate(F.slice(d, 2, F.greatest(F.size(rows) - 1, F.lit(1))), F.struct(d[0][c].alias("m"), F.lit(0.1).alias("s")), lambda a, x: F.struct(((a["m"] * (n - 1) + x[c]) / n).alias("m"), F.sqrt(((n - 1) * a["s"] * a["s"] + (x[c] - a["m"]) * (x[c] - (a["m"] * (n - 1) + x[c]) / n)) / n).alias("s")))
    return {f"{p}_{k}": step(c)[f] for p, c in (("w", "width_3d"), ("h", "height_3d")) for k, f in (("mean", "m"), ("std", "s"))}


def smoothed_sizes(det: DataFrame) -> DataFrame:
    """The filtered family's sizes: a fold over the ordered detections."""
    rows = det.groupBy("scene", "label").agg(F.collect_list(F.struct("det_ord", "width_3d", "height_3d")).alias("d"))
    return rows.select("scene", "label", *[v.alias(k) for k, v in size_folds(F.col("d")).items()])


def track_moments(det: DataFrame) -> DataFrame:
    """Sample covariances plus 0.01 on the diagonal, median sizes, trace as uncertainty, existence min(1, 0.5 + 0.1 n)."""
    c = lambda a, b: F.coalesce(F.covar_samp(a, b), F.lit(0.0)) + (0.01 if a == b else 0.0)
    out = det.groupBy("scene", "label").agg(*[F.avg(x).alias(f"m{x}") for x in "xyz"], *[c(a, b).alias(f"c{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))], F.median("width_3d").alias("w3"), F.median("height_3d").alias("h3"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("uncertainty", F.col("cxx") + F.col("cyy") + F.col("czz")).withColumn("existence", F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n")))


def moments(on: Column | None = None) -> tuple[dict[str, Column], dict[str, Column]]:
    """Sums over an entity's detections (those that are on) with their weight _w, and from these mx, my, mz, COV, position_uncertainty and obs_count of entity_beliefs."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    here = lambda v: v if on is None else F.when(on, v)
    w = F.col("_w")
    sums = {"_sn": F.count(here(F.lit(1))), "_s": F.sum(here(w)), **{f"_s{c}": F.sum(here(w * F.col(c))) for c in "xyz"}, **{f"_s{a}{b}": F.sum(here(w * F.col(a) * F.col(b))) for a, b in pairs}}
    mean = {c: F.col(f"_s{c}") / F.col("_s") for c in "xyz"}
    cov = {n: F.col(f"_s{a}{b}") / F.col("_s") - mean[a] * mean[b] for n, (a, b) in zip(COV, pairs)}
    return sums, {**{f"m{c}": mean[c] for c in "xyz"}, **cov, "entity_uncertainty": F.sqrt(F.greatest(cov["cxx"] + cov["cyy"] + cov["czz"], F.lit(0.0))), "obs_count": F.col("_sn")}


def noise() -> Column:
    """How much of a misfit a detection is to its entity, whose mx, my, mz and COV stand in its row."""
    d = tuple(F.col(c) - F.col(f"m{c}") for c in "xyz")
    return F.col("position_uncertainty") + 0.5 * mahalanobis(d, [F.col(c) for c in COV], 1e-6) + 0.3 * (1 - F.col("confidence"))


def noise_scores(det: DataFrame, entities: DataFrame) -> DataFrame:
    """Each detection with how much of a misfit to its entity it is: uncertainty + half the Mahalanobis distance + 0.3 * (1 - confidence)."""
    e = entities.select("scene", "label", "mx", "my", "mz", *COV, F.col("position_uncertainty").alias("entity_uncertainty"), "obs_count")
    return det.join(e, ["scene", "label"]).withColumn("noise", noise())


def noisiest(det: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """The detections that a round of refinement takes out: of entities with four or more whose uncertainty is above the threshold, the max(1, min(2, n / 4)) noisiest."""
    scored = noise_scores(det, entities).filter((F.col("obs_count") >= 4) & (F.col("entity_uncertainty") > threshold))
    rank = F.row_number().over(Window.partitionBy("scene", "label").orderBy(F.desc("noise"), "det_ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= at_most())


def at_most() -> Column:
    """How many detections of an entity a round takes out."""
    return F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.col("obs_count") / 4)))


def entity_rounds(det: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Entities in each round, a round more than thresholds, which take the noisiest out after theirs: scene, label, rounds (array of o, f, u).

    o: det_ord of the first detection left, null where no entity is; f: its frames in order; u: its uncertainty. Detections dealt by scene are sent
    nowhere else and kept nowhere: each has the number of the last round that it is in.
    """
    by, sure = Window.partitionBy("scene", "label"), lambda: ~(F.isnan("mx") | F.isnan("my") | F.isnan("mz"))
    d = det.select("scene", "label", "frame_idx", "det_ord", "confidence", "position_uncertainty", "x", "y", "z").withColumns({"_w": weight(), "_in": F.lit(len(thresholds) + 1)})
    kept = d.columns
    for k, threshold in enumerate(thresholds, 1):
        on = F.col("_in") >= k
        sums, own = moments(on)
        d = d.withColumns({c: v.over(by) for c, v in sums.items()}).withColumns(own).withColumns({"_noise": F.round(noise(), 9), "_on": on})
        d = d.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_on"), F.desc("_noise"), "det_ord")))
        goes = F.col("_on") & (F.col("obs_count") >= 4) & (F.col("entity_uncertainty") > threshold) & sure() & (F.col("_rank") <= at_most())
        d = d.withColumn("_in", F.when(F.coalesce(goes, F.lit(False)), k).otherwise(F.col("_in"))).select(*kept)
    numbers, all_, state = range(1, len(thresholds) + 2), {}, {}
    for k in numbers:
        on = F.col("_in") >= k
        sums, own = moments(on)
        all_ |= {f"{c}_{k}": v for c, v in sums.items()} | {f"o_{k}": F.min(F.when(on, F.col("det_ord"))), f"f_{k}": F.sort_array(F.collect_set(F.when(on, F.col("frame_idx"))))}
        state[k] = own
    e = d.groupBy("scene", "label").agg(*[v.alias(c) for c, v in all_.items()])
    rounds = []
    for k in numbers:
        e = e.withColumnsRenamed({f"{c}_{k}": c for c in moments()[0]}).withColumns(state[k])
        e = e.withColumn(f"r_{k}", F.struct(F.when(sure() | F.col("mx").isNull(), F.col(f"o_{k}")).alias("o"), F.col(f"f_{k}").alias("f"), F.col("entity_uncertainty").alias("u"))).drop(*moments()[0], *state[k])
        rounds.append(F.col(f"r_{k}"))
    return e.select("scene", "label", F.array(*rounds).alias("rounds"))
