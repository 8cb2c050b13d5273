"""Boxes, points, affine maps and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.core import let


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x, y, w, h) boxes; negative sizes count as 0, an empty union gives 0; null if a number is."""
    size = lambda v: F.greatest(v, F.lit(0.0))
    (ax, ay, aw, ah), (bx, by, bw, bh) = (a[0], a[1], size(a[2]), size(a[3])), (b[0], b[1], size(b[2]), size(b[3]))
    w = size(F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = size(F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    known = F.lit(True)
    for v in (*a, *b):  # least and greatest pass nulls over
        known = known & v.isNotNull()
    return F.when(known, F.when(union > 0, w * h / union).otherwise(F.lit(0.0)))


def affine_point(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def affine_box(m: list[float], x: Column, y: Column, w: Column, h: Column, digits: int = 6) -> tuple[Column, ...]:
    """Hull (x, y, w, h) of a mapped box, rounded."""
    corners = [affine_point(m, px, py) for px in (x, x + w) for py in (y, y + h)]
    xs, ys = [F.array(*[c[k] for c in corners]) for k in (0, 1)]
    r = lambda v: F.round(v, digits)
    return r(F.array_min(xs)), r(F.array_min(ys)), r(F.array_max(xs) - F.array_min(xs)), r(F.array_max(ys) - F.array_min(ys))


def int_box(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """0..1000 integer box: halves up, clamped, at least 1 wide and high, moved in."""
    k = lambda v: F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(v * 1000 + 0.5)))
    ww, hh = F.greatest(F.lit(1), k(w)), F.greatest(F.lit(1), k(h))
    return F.least(k(x), 1000 - ww), F.least(k(y), 1000 - hh), ww, hh


def build_affine(angle: Column, shear: Column, scale: Column) -> list[Column]:
    """2 x 3 map that turns, shears and scales about the page centre (0.5, 0.5)."""
    c, s = F.cos(F.radians(angle)) * scale, F.sin(F.radians(angle)) * scale
    a, b, d, e = c, c * shear - s, s, s * shear + c
    return [a, b, 0.5 - (a + b) * 0.5, d, e, 0.5 - (d + e) * 0.5]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def finite_report(v: Column, limit: float = 65504.0) -> Column:
    """struct(nan, inf, over, absmax, ok) of a vector."""
    count = lambda f: F.size(F.filter(v, f)).cast("bigint")
    inf = F.lit(float("inf"))
    nan, infs = count(lambda x: F.isnan(x)), count(lambda x: F.abs(x.cast("double")) == inf)
    over = count(lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) > limit))
    top = F.array_max(F.transform(F.filter(v, lambda x: ~F.isnan(x)), lambda x: F.abs(x.cast("double"))))
    return F.struct(nan.alias("nan"), infs.alias("inf"), over.alias("over"), top.alias("absmax"), ((nan + infs + over) == 0).alias("ok"))


def cell_of(point: Column, grid: int) -> Column:
    """Grid cell that holds a coordinate in 0..1."""
    return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(point * grid).cast("int")))


def bilinear(vec: Column, px: Column, py: Column, grid: int) -> Column:
    """Value of a row-major grid (array of grid * grid numbers) at a point, between cell centres; 0 outside the grid."""

    def at(v: Column) -> Column:
        gx, gy = px * grid - 0.5, py * grid - 0.5
        x0, y0 = F.floor(gx).cast("int"), F.floor(gy).cast("int")
        fx, fy = gx - x0, gy - y0
        total = F.lit(0.0)
        for dx, wx in ((0, 1 - fx), (1, fx)):
            for dy, wy in ((0, 1 - fy), (1, fy)):
                x, y = x0 + dx, y0 + dy
                inside = (x >= 0) & (x < grid) & (y >= 0) & (y < grid)
                total = total + F.when(inside, wx * wy * F.get(v, y * grid + x).cast("double")).otherwise(0.0)
        return total

    return let(vec, at)
