"""Column expressions on 3-D points.  A vector is a triple of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def literal(x: float, y: float, z: float) -> Vec:
    return (F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))  # type: ignore[return-value]


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)  # type: ignore[return-value]


def negate(a: Vec) -> Vec:
    return tuple(-p for p in a)  # type: ignore[return-value]


def divide(a: Vec, k: Column) -> Vec:
    """Division where a zero divisor counts as one."""
    d = F.when(k == 0, F.lit(1.0)).otherwise(k)
    return tuple(p / d for p in a)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """Unit vector; the zero vector stays zero."""
    n = length(a)
    return divide(a, n)


def dist(a: Vec, b: Vec) -> Column:
    return length(sub(a, b))


def dist2d(a: Vec, b: Vec) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(dx * dx + dy * dy)


def angle(a: Vec, b: Vec) -> Column:
    c = dot(unit(a), unit(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angle_deg(a: Vec, b: Vec) -> Column:
    return angle(a, b) / math.pi * 180


def position_key(a: Vec) -> Column:
    """Text key of a position at three decimals."""
    return F.format_string("%.3f-%.3f-%.3f", *a)


def position_cells(a: Vec) -> Column:
    """Exact integer key of a position at three decimals, for joins."""
    return F.struct(*[F.round(p * 1000).cast("bigint").alias(n) for p, n in zip(a, "xyz")])


def truncated_key(a: Vec) -> Column:
    """Text key of the integer parts (towards zero)."""
    return F.concat_ws("-", *[p.cast("bigint").cast("string") for p in a])


def voxel(p: Column) -> Column:
    """Voxel index of a coordinate (half to even)."""
    return F.bround(p).cast("bigint")


def out_of_bound(a: Vec, shape: tuple) -> Column:
    bad = F.lit(False)
    for p, n in zip(a, shape):
        bad = bad | (p < 0) | (p > n - 1)
    return bad


def out_of_box(a: Vec, box: tuple, allowance: float = 0) -> Column:
    """``box`` is x0, x1, y0, y1, z0, z1; the upper limit is ``max - 1 + allowance``."""
    bad = F.lit(False)
    for i, p in enumerate(a):
        bad = bad | (p < box[2 * i] - allowance) | (p > box[2 * i + 1] - 1 + allowance)
    return bad


def clamp(a: Vec, shape: tuple, lower: tuple = (0, 0, 0)) -> Vec:
    return tuple(
        F.least(F.greatest(p, F.lit(float(lo))), F.lit(float(n - 1))) for p, n, lo in zip(a, shape, lower)
    )  # type: ignore[return-value]


def plane_axes(n: Vec) -> tuple[Vec, Vec]:
    """Two unit axes of the plane across ``n`` (not normalised)."""
    xn, yn, zn = n
    side = yn * yn + zn * zn
    flat = side == 0
    root = F.sqrt(side * side + xn * xn * yn * yn + xn * xn * zn * zn)
    safe_root = F.when(flat, F.lit(1.0)).otherwise(root)
    safe_side = F.when(flat, F.lit(1.0)).otherwise(F.sqrt(side))
    zero = F.lit(0.0)
    u = (
        F.when(flat, zero).otherwise(side / safe_root),
        F.when(flat, zero).otherwise(-xn * yn / safe_root),
        F.when(flat, F.lit(-1.0)).otherwise(-zn * xn / safe_root),
    )
    v = (
        zero,
        F.when(flat, F.lit(1.0)).otherwise(zn / safe_side),
        F.when(flat, zero).otherwise(-yn / safe_side),
    )
    return u, v


def cross_section_point(n: Vec, p: Vec, u: Column | float, v: Column | float) -> Vec:
    au, av = plane_axes(n)
    return add(p, add(scale(au, u), scale(av, v)))


def normal_plane_point(n: Vec, p: Vec, u: Column | float, v: Column | float, axis: str = "x") -> Vec:
    """Point of a plane through ``n`` whose other axis has no part along ``axis``."""
    n = unit(n)
    i, j = {"x": (1, 2), "y": (0, 2), "z": (1, 0)}[axis]
    root = F.sqrt(n[i] * n[i] + n[j] * n[j])
    safe = F.when(root == 0, F.lit(1.0)).otherwise(root)
    across = [F.lit(0.0)] * 3
    if axis == "z":
        across[0], across[1] = n[1] / safe, -n[0] / safe
    else:
        across[i], across[2] = n[2] / safe, -n[i] / safe
    return add(p, add(scale(tuple(across), u), scale(n, v)))


def _local_frame(n: Vec) -> tuple[Vec, Vec, Vec]:
    u, v = plane_axes(n)
    return negate(u), v, n


def to_local(n: Vec, p: Vec, q: Vec) -> Vec:
    """``q`` in the orthonormal frame at ``p`` whose third axis is ``n``."""
    n = unit(n)
    same = (n[1] == 0) & (n[2] == 0)
    d = sub(q, p)
    return tuple(F.when(same, own).otherwise(dot(ax, d)) for own, ax in zip(q, _local_frame(n)))  # type: ignore


def from_local(n: Vec, p: Vec, q: Vec) -> Vec:
    n = unit(n)
    same = (n[1] == 0) & (n[2] == 0)
    u, v, w = _local_frame(n)
    out = add(p, add(add(scale(u, q[0]), scale(v, q[1])), scale(w, q[2])))
    return tuple(F.when(same, own).otherwise(o) for own, o in zip(q, out))  # type: ignore[return-value]


def directions26() -> list[tuple[int, float, float, float]]:
    """Unit vectors to the 26 neighbours of a voxel, numbered in x, y, z order."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    return [(i, *[s / math.sqrt(sum(t * t for t in d)) for s in d]) for i, d in enumerate(steps)]


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def best_direction(a: Vec) -> Column:
    """Number of the direction with the largest positive dot product, NULL if none is positive."""

    def least_size(v):
        # The best direction along one, two or three axes takes the largest components.
        low, mid, most = (v["m"][i] for i in range(3))
        one, two, three = most, (most + mid) / math.sqrt(2), (most + mid + low) / math.sqrt(3)
        return F.when((one >= two) & (one >= three), most).when(two >= three, mid).otherwise(F.lit(0.0))

    def number(w):
        step = [F.when(F.abs(w[c]) >= w["least"], F.signum(w[c])).otherwise(F.lit(0.0)) + 1 for c in "xyz"]
        # Cells of a cube in x, y, z order without its middle.
        names = F.array(*[F.lit(i - (i > 13)) for i in range(27)])
        return F.when(w["any"], names[(9 * step[0] + 3 * step[1] + step[2]).cast("int")])

    parts = [c.alias(n) for c, n in zip(a, "xyz")]
    sizes = F.struct(*parts, F.array_sort(F.array(*[F.abs(c) for c in a])).alias("m"))
    return bound(sizes, lambda v: bound(F.struct(*[v[c].alias(c) for c in "xyz"], least_size(v).alias("least"), (v["m"][2] > 0).alias("any")), number))


def sphere_point(i: Column, n: int, radius: float = 1.0) -> Vec:
    """The i-th of n evenly spread points of a sphere (golden-angle spiral)."""
    z = (2 * i + 1) / float(n) - 1
    turn = ((i + 1) % n) * (math.pi * (3.0 - math.sqrt(5.0)))
    ring = F.sqrt(1 - z * z)
    return (F.cos(turn) * ring * radius, F.sin(turn) * ring * radius, z * radius)
