"""Geometry as column arithmetic: cameras, grids, voxels, boxes, directions, Gaussians. Nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def rotate_back(r: list[Column], v: Vec) -> Vec:
    """R-transposed times v; r: nine columns, row by row."""
    return tuple(r[k] * v[0] + r[3 + k] * v[1] + r[6 + k] * v[2] for k in range(3))


def rotate(r: list[Column], v: Vec) -> Vec:
    return tuple(r[3 * k] * v[0] + r[3 * k + 1] * v[1] + r[3 * k + 2] * v[2] for k in range(3))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def pixel_to_camera(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Vec:
    return ((u - cx) / fx * depth, (v - cy) / fy * depth, depth)


def pixel_to_world(u, v, depth, fx, fy, cx, cy, r: list[Column], t: Vec) -> Vec:
    """Pinhole back-projection under world-to-camera (R, t): R' * (camera - t)."""
    return rotate_back(r, minus(pixel_to_camera(u, v, depth, fx, fy, cx, cy), t))


def camera_center(r: list[Column], t: Vec) -> Vec:
    return tuple(-x for x in rotate_back(r, t))


def camera_to_world(r: list[Column], t: Vec, p: Vec) -> Vec:
    """The tracking family's convention: R' * p + t."""
    return plus(rotate_back(r, p), t)


def world_to_camera(r: list[Column], t: Vec, p: Vec) -> Vec:
    """The inverse of camera_to_world."""
    return rotate(r, minus(p, t))


def pixel_size(w: Column, h: Column, depth: Column, fx: Column, fy: Column) -> tuple[Column, Column]:
    return w * depth / fx, h * depth / fy


def position_uncertainty(depth_std: Column, confidence: Column) -> Column:
    return 0.5 * depth_std + 0.5 * (1.0 - confidence)


def grid_cell(x: Column, low: Column, high: Column, n: int = 64) -> Column:
    """The cell of a grid of n that x is in, within [0, n - 1]; the middle where bounds are missing."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low + 1e-6)))
    return F.coalesce((part * (n - 1) + BORDER).cast("int"), F.lit(n // 2))


def metres_per_cell(calibrated: Column, raw: Column) -> Column:
    return F.coalesce(calibrated, raw, F.lit(0.08))


def scale_factor(metres: Column, raw: Column) -> Column:
    return F.when(raw > 1e-8, F.try_divide(metres, raw)).otherwise(F.lit(1.0))


#: A place this near below a border of cells (in cells) is past it: sums in another order differ in their last bits, and cells must not.
BORDER = 1e-9


def voxel_floor(x: Column, size: float) -> Column:
    return F.floor(x / size + BORDER).cast("int")


def voxel_trunc(x: Column, size: float) -> Column:
    """Towards zero, as the ray casters have it: differs from voxel_floor for negative x."""
    return (x / size + F.signum(x) * BORDER).cast("int")


def voxel_center(i: Column, size: float) -> Column:
    return (i + 0.5) * size


def box_volume(low: Vec, high: Vec) -> Column:
    d = minus(high, low)
    return d[0] * d[1] * d[2]


def box_contains(low: Vec, high: Vec, p: Vec) -> Column:
    return p[0].between(low[0], high[0]) & p[1].between(low[1], high[1]) & p[2].between(low[2], high[2])


def boxes_meet(low_a: Vec, high_a: Vec, low_b: Vec, high_b: Vec) -> Column:
    out = F.lit(True)
    for k in range(3):
        out = out & (low_a[k] <= high_b[k]) & (high_a[k] >= low_b[k])
    return out


def quadrant(obs: tuple[Column, Column], facing: tuple[Column, Column], target: tuple[Column, Column]) -> Column:
    """front/behind-right/left of the target seen from obs, by signs in the XZ plane; facing the own place means looking along z."""
    fx, fz = facing[0] - obs[0], facing[1] - obs[1]
    here = F.sqrt(fx * fx + fz * fz) < 1e-6
    fx, fz = F.when(here, F.lit(0.0)).otherwise(fx), F.when(here, F.lit(1.0)).otherwise(fz)  # signs need no unit length
    tx, tz = target[0] - obs[0], target[1] - obs[1]
    ahead, right = tx * fx + tz * fz, fx * tz - fz * tx
    word = F.concat(F.when(ahead >= 0, "front").otherwise("behind"), F.lit("-"), F.when(right >= 0, "right").otherwise("left"))
    return F.when(F.sqrt(tx * tx + tz * tz) < 1e-6, F.lit("same_position")).otherwise(word)


def sector(obs: tuple[Column, Column], facing: tuple[Column, Column], target: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """One of eight directions, its angle in degrees (right positive), and a confidence.

    An angle of exactly +157.5 has no direction ("unknown"); the confidence is 0 in a direction's middle and 1 at its edges.
    """
    fx, fz, tx, tz = facing[0] - obs[0], facing[1] - obs[1], target[0] - obs[0], target[1] - obs[1]
    nf, nt = F.sqrt(fx * fx + fz * fz), F.sqrt(tx * tx + tz * tz)
    fx, fz, tx, tz = F.try_divide(fx, nf), F.try_divide(fz, nf), F.try_divide(tx, nt), F.try_divide(tz, nt)
    angle = F.atan2(tx * fz - tz * fx, tx * fx + tz * fz) * 180 / math.pi
    words = [(-157.5, -112.5, "back-left"), (-112.5, -67.5, "left"), (-67.5, -22.5, "front-left"), (-22.5, 22.5, "front"), (22.5, 67.5, "front-right"), (67.5, 112.5, "right"), (112.5, 157.5, "back-right")]
    out = F.when((angle > 157.5) | (angle < -157.5), F.lit("back"))
    for low, high, word in words:
        out = out.when((angle >= low) & (angle < high), F.lit(word))
    sure = F.least(F.lit(1.0), F.array_min(F.array(*[F.abs(angle - m) for m in (0, 45, 90, 135, 180, -45, -90, -135)])) / 22.5)
    blind, same = nf < 1e-6, nt < 1e-6
    pick = lambda a, b, c: F.when(blind, F.lit(a)).when(same, F.lit(b)).otherwise(c)
    return pick("unknown", "same_position", out.otherwise(F.lit("unknown"))), pick(0.0, 0.0, angle), pick(0.0, 0.5, sure)


def relation_word(d: Vec, back: bool = False) -> Column:
    """above/below where the unit vector's y says so, then the greater of its other axes as a word, joined by _; back: what opposite_relation makes of it, from the vector."""
    n = norm(d) + 1e-8
    x, y, z = (v / n for v in d)
    up, down, behind = ("below", "above", "in_front_of") if back else ("above", "below", "behind")
    return F.concat_ws(
        "_",
        F.when(y > 0.5, up).when(y < -0.5, down),
        F.when(F.abs(z) > F.abs(x), F.when(z > 0, "in_front_of").otherwise(behind)).otherwise(F.when(x > 0, "right_of").otherwise("left_of")),
    )


def opposite_relation(relation: Column) -> Column:
    """above and below change places, as does a bare "behind"; words of several parts are parted at _ and so stay as they are."""
    turn = F.create_map(*[F.lit(x) for x in ("above", "below", "below", "above", "behind", "in_front_of", "near", "near")])
    return F.array_join(F.transform(F.split(relation, "_"), lambda p: F.coalesce(F.try_element_at(turn, p), p)), "_")


def overlap_probability(d: Column, sa: Column, sb: Column) -> Column:
    """exp(-d / (sa + sb)); 1 or 0 where both spreads vanish."""
    return F.when(sa + sb < 1e-6, F.when(d < 0.1, 1.0).otherwise(0.0)).otherwise(F.exp(F.try_divide(-d, sa + sb)))


def inverse3(c: list[Column]) -> list[Column]:
    """The inverse of a symmetric 3x3 matrix (xx, xy, xz, yy, yz, zz), by its adjugate."""
    xx, xy, xz, yy, yz, zz = c
    a, b, d = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    det = xx * a + xy * b + xz * d
    return [F.try_divide(v, det) for v in (a, b, d, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)]


def mahalanobis(d: Vec, c: list[Column], eps: float = 0.0) -> Column:
    """sqrt(d' (C + eps I)^-1 d)."""
    i = inverse3([c[0] + eps, c[1], c[2], c[3] + eps, c[4], c[5] + eps])
    q = i[0] * d[0] * d[0] + i[3] * d[1] * d[1] + i[5] * d[2] * d[2] + 2 * (i[1] * d[0] * d[1] + i[2] * d[0] * d[2] + i[4] * d[1] * d[2])
    return F.sqrt(F.greatest(q, F.lit(0.0)))


def largest_eigenvalue(c: list[Column]) -> Column:
    """Of a symmetric 3x3 matrix (xx, xy, xz, yy, yz, zz), in closed form."""
    xx, xy, xz, yy, yz, zz = c
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    b = [F.try_divide(v, p) for v in (xx - q, xy, xz, yy - q, yz, zz - q)]
    half = (b[0] * (b[3] * b[5] - b[4] * b[4]) - b[1] * (b[1] * b[5] - b[4] * b[2]) + b[2] * (b[1] * b[4] - b[3] * b[2])) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    return F.when(p < 1e-12, q).otherwise(q + 2 * p * F.cos(phi))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where one has no length."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ab = add(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    n = lambda x: F.sqrt(add(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.when((n(a) == 0) | (n(b) == 0), F.lit(0.0)).otherwise(F.try_divide(ab, n(a) * n(b)))


def frame_sample(total: Column, n: int) -> Column:
    """n frame numbers spread evenly from 0 to total - 1, as an array; one alone is 0."""
    if n == 1:
        return F.array(F.lit(0))
    step = (total - 1) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, total - 1).otherwise(F.floor(i * step)).cast("int"))


def sphere_cone(degrees: float) -> float:
    return math.cos(math.radians(degrees))
