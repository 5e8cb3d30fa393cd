"""Planes of a scene's points by random samples: in one task where a scene is small, else with points and guesses meeting over all tasks."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.session import cut

#: How level a plane's normal is (its y) for a floor or ceiling, and for a wall.
LEVEL, UPRIGHT = 0.85, 0.15


def kind_of(ny: Column) -> Column:
    return F.when(F.abs(ny) > LEVEL, "horizontal").when(F.abs(ny) < UPRIGHT, "vertical").otherwise("other")


def guesses(points: DataFrame, tries: int, seed: int) -> DataFrame:
    """scene, h, nx, ny, nz, d: planes through three points drawn for each try, which are the same in every run.

    Three times `tries` points of a scene at most are drawn from, those of the least hashes, so no task sees more of a scene; tries that
    draw points in one line are no planes.
    """
    rank = F.row_number().over(Window.partitionBy("scene").orderBy("_h", "x", "y", "z"))
    some = points.withColumn("_h", F.xxhash64("x", "y", "z", F.lit(seed))).withColumn("_k", rank).filter(F.col("_k") <= 3 * tries)
    drawn = some.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("_k", "x", "y", "z"))).alias("_p"))
    drawn = drawn.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    pick = lambda i: F.get("_p", F.pmod(F.xxhash64("h", F.lit(seed), F.lit(i)), F.size("_p")).cast("int"))
    t = drawn.select("scene", "h", *[pick(i).alias(f"p{i}") for i in range(3)])
    a, b = ({c: F.col(f"p{i}.{c}") - F.col(f"p0.{c}") for c in "xyz"} for i in (1, 2))
    n = {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}
    t = t.select("scene", "h", "p0", *[v.alias(f"c{c}") for c, v in n.items()]).withColumn("_n", F.sqrt(sum((F.col(f"c{c}") * F.col(f"c{c}") for c in "yz"), F.col("cx") * F.col("cx")))).filter("_n > 1e-9")
    t = t.select("scene", "h", "p0", *[(F.col(f"c{c}") / F.col("_n")).alias(f"n{c}") for c in "xyz"])
    return t.select("scene", "h", "nx", "ny", "nz", (-reduce(lambda p, q: p + q, [F.col(f"n{c}") * F.col(f"p0.{c}") for c in "xyz"])).alias("d"))


def away() -> Column:
    """A point's distance from a plane."""
    return F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))


#: Scenes of up to so many points are done in one task each; the points of larger ones meet their guesses over all tasks.
SMALL = 50_000
_M = [np.uint64(x) for x in (0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(*columns: np.ndarray) -> np.ndarray:
    """xxhash64 of columns of doubles or ints, as the SQL function has it."""
    out = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        if c.dtype.kind == "f":
            word = (c + 0.0).view(np.uint64)
            out = out + _M[5] + np.uint64(8) ^ _turn(word * _M[2], 31) * _M[1]
            out = _turn(out, 27) * _M[1] + _M[4]
        else:
            word = c.astype(np.int32).view(np.uint32).astype(np.uint64)
            out = out + _M[5] + np.uint64(4) ^ word * _M[1]
            out = _turn(out, 23) * _M[2] + _M[3]
        out = (out ^ out >> np.uint64(33)) * _M[2]
        out = (out ^ out >> np.uint64(29)) * _M[3]
        out = out ^ out >> np.uint64(32)
    return out.view(np.int64)


@lru_cache(maxsize=64)
def _draws(tries: int, seed: int, i: int) -> np.ndarray:
    """For each try a number that its point i is drawn by, the same in every scene."""
    return hashed(np.arange(tries, dtype=np.int32), np.full(tries, seed, np.int32), np.full(tries, i, np.int32))


def _guess(p: np.ndarray, tries: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """guesses() of one scene's points (rows x, y, z): h, and nx, ny, nz, d as rows."""
    h = hashed(*p, np.full(p.shape[1], seed, np.int32))
    some = p[:, np.lexsort((p[2], p[1], p[0], h))[: 3 * tries]]
    number = np.arange(tries, dtype=np.int32)
    a, b, c = (some[:, _draws(tries, seed, i) % some.shape[1]] for i in range(3))
    u, v = b - a, c - a
    n = np.stack([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])
    length = np.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    fine = length > 1e-9
    n, a = n[:, fine] / length[fine], a[:, fine]
    return number[fine], np.stack([*n, -(n[0] * a[0] + n[1] * a[1] + n[2] * a[2])])


def _rounds(p: np.ndarray, planes: int, tries: int, near: float, least: int, seed: int) -> list[tuple]:
    """Planes of one scene's points (rows x, y, z), as _over_tasks has them."""
    found = []
    for k in range(planes):
        if p.shape[1] < max(least, 3):
            break
        h, g = _guess(p, tries, seed * 1000 + k)
        if not len(h):
            break
        count = np.zeros(len(h), np.int64)
        for at in range(0, p.shape[1], 256):
            x, y, z = (c[at : at + 256, None] for c in p)
            far = g[0] * x
            other = g[1] * y
            far += other
            far += np.multiply(g[2], z, out=other)
            far += g[3]
            count += np.count_nonzero(np.abs(far, out=far) < near, axis=0)
        best = int(count.argmax())
        if count[best] < least:
            break
        nx, ny, nz, d = g[:, best]
        inside = np.abs(nx * p[0] + ny * p[1] + nz * p[2] + d) < near
        found.append((k, nx, ny, nz, d, int(count[best]), *p[:, inside].mean(1)))
        p = p[:, ~inside]
    return found


def room_planes(points: DataFrame, planes: int = 8, tries: int = 200, near: float = 0.05, least: int = 50, seed: int = 0, small: int = SMALL) -> DataFrame:
    """Planes of each scene, the largest first: scene, plane, nx, ny, nz, d, inliers, px, py, pz (the inliers' middle), kind (horizontal, vertical, other).

    In each round a scene's points meet its `tries` guesses. The guess with the most inliers (of equals the first) is its plane, if they are
    `least` or more, and its inliers go. A scene without a plane in a round, or with fewer than max(least, 3) points left, is done.
    A scene of up to `small` points goes through all rounds in one task; larger ones, or with points that lack a place, over all tasks.
    """
    points = cut(points.select("scene", "x", "y", "z"))
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in "xyz"])
    large = points.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.every(whole & F.col("scene").isNotNull()).alias("whole"))
    large = cut(large.filter((F.col("n") > small) | ~F.col("whole")).select("scene"))
    kind = points.schema["scene"].dataType.simpleString()
    own = points if large.isEmpty() else points.join(large, "scene", "left_anti").filter("scene IS NOT NULL")

    def scene_planes(key: tuple, table: pa.Table) -> pa.Table:
        rows = _rounds(np.stack([table.column(c).to_numpy() for c in "xyz"]), planes, tries, near, least, seed)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.float64()] * 4, pa.int64(), *[pa.float64()] * 3])] if rows else [pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 4, pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3]
        return pa.table([pa.repeat(key[0], len(rows)), *columns], names=["scene", "plane", "nx", "ny", "nz", "d", "inliers", "px", "py", "pz"])

    out = own.select("scene", *[F.col(c).cast("double").alias(c) for c in "xyz"]).groupBy("scene").applyInArrow(scene_planes, f"scene {kind}, plane long, nx double, ny double, nz double, d double, inliers long, px double, py double, pz double")
    out = out.withColumn("kind", kind_of(F.col("ny")))
    return out if own is points else out.unionByName(_over_tasks(points.join(large, "scene", "left_semi"), planes, tries, near, least, seed))


def _over_tasks(points: DataFrame, planes: int, tries: int, near: float, least: int, seed: int) -> DataFrame:
    """Planes of scenes whose points lie in any number of tasks: what lies near a guess is counted by partial sums."""
    left, found = cut(points.select("scene", "x", "y", "z")), []
    for k in range(planes):
        enough = left.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(least, 3)).select("scene")
        open_ = left.join(enough, "scene", "left_semi")
        hyp = cut(guesses(open_, tries, seed * 1000 + k))
        counts = open_.join(hyp, "scene").filter(away() < near).groupBy("scene", "h").agg(F.count(F.lit(1)).alias("inliers"), *[F.avg(c).alias(f"p{c}") for c in "xyz"])
        best = counts.groupBy("scene").agg(F.max_by(F.struct("h", "inliers", "px", "py", "pz"), F.struct("inliers", -F.col("h"))).alias("b")).select("scene", "b.*").filter(F.col("inliers") >= least)
        best = cut(best.join(hyp, ["scene", "h"]))
        if best.isEmpty():
            break
        found.append(best.select("scene", F.lit(k).cast("long").alias("plane"), "nx", "ny", "nz", "d", "inliers", "px", "py", "pz", kind_of(F.col("ny")).alias("kind")))
        left = cut(open_.join(best.select("scene", "nx", "ny", "nz", "d"), "scene").filter(away() >= near).select("scene", "x", "y", "z"))
    if not found:
        kind = points.schema["scene"].dataType.simpleString()
        return points.sparkSession.createDataFrame([], f"scene {kind}, plane long, nx double, ny double, nz double, d double, inliers long, px double, py double, pz double, kind string")
    return reduce(DataFrame.unionByName, found)
