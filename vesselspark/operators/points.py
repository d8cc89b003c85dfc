"""Row-level and small-group operators on points, boxes and voxel values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from ..plans.blocks import quantiles, ranked


def path(links: DataFrame) -> DataFrame:
    """Points every unit step from (ax, ay, az) to (bx, by, bz), the end included."""
    a, b = g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz")
    n = F.floor(g.dist(a, b))
    out = links.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    f = F.when(F.col("k") == F.col("_n"), F.lit(1.0)).otherwise(F.col("k") / F.greatest(F.col("_n"), F.lit(1)))
    return out.withColumns({c: p + (q - p) * f for c, p, q in zip("xyz", a, b)}).drop("_n")


def path_sets(links: DataFrame) -> DataFrame:
    """The points of ``path`` as one array (k, x, y, z) a link, ``_at``."""
    a, b = g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz")
    n = F.floor(g.dist(a, b))

    def spot(k):
        f = F.when(k == n, F.lit(1.0)).otherwise(k / F.greatest(n, F.lit(1)))
        return F.struct(k.cast("int").alias("k"), *[(p + (q - p) * f).alias(c) for c, p, q in zip("xyz", a, b)])

    return links.withColumn("_at", F.transform(F.sequence(F.lit(0).cast("bigint"), n), spot))


RTM = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["t1", "t2", "t3"]


def rigid(points: DataFrame, transforms: DataFrame, keys: Sequence[str] = ("case_id",), z_ratio: float = 1.0) -> DataFrame:
    """Apply ``transforms`` (rotation rows r11..r33, translation t1..t3) to x, y, z; then divide z."""
    moved = points.join(transforms, list(keys))
    new = {
        c: F.col(f"r{i}1") * F.col("x") + F.col(f"r{i}2") * F.col("y") + F.col(f"r{i}3") * F.col("z") + F.col(f"t{i}")
        for i, c in enumerate("xyz", 1)
    }
    new["z"] = new["z"] / z_ratio
    return moved.withColumns(new).drop(*RTM)


def compose(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Transform that applies ``first`` and then ``second``."""
    b = second.select(*keys, *[F.col(c).alias(f"b_{c}") for c in RTM])
    both = first.join(b, list(keys))
    new = {
        f"r{i}{j}": sum((F.col(f"b_r{i}{k}") * F.col(f"r{k}{j}") for k in (1, 2, 3)), F.lit(0.0))
        for i in (1, 2, 3) for j in (1, 2, 3)
    }
    new |= {
        f"t{i}": sum((F.col(f"b_r{i}{k}") * F.col(f"t{k}") for k in (1, 2, 3)), F.lit(0.0)) + F.col(f"b_t{i}")
        for i in (1, 2, 3)
    }
    return both.select(*keys, *[new[c].alias(c) for c in RTM])


def to_physical(transforms: DataFrame, fixed: Sequence[float], moving: Sequence[float], inverse: bool = False) -> DataFrame:
    """Pixel-unit transform to physical units by the spacings (or back)."""
    def unit(i: int, j: int) -> float:
        k = moving[i - 1] / fixed[j - 1]
        return 1 / k if inverse else k

    new = {f"r{i}{j}": F.col(f"r{i}{j}") * unit(i, j) for i in (1, 2, 3) for j in (1, 2, 3)}
    new |= {f"t{i}": F.col(f"t{i}") * (1 / moving[i - 1] if inverse else moving[i - 1]) for i in (1, 2, 3)}
    return transforms.withColumns(new)


def orientation(d: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Dominant axis (0..2) and sign of each column of a row-major 3 x 3 direction matrix."""
    axes, signs = [], []
    for j in range(3):
        col = [d[j], d[3 + j], d[6 + j]]
        big = F.greatest(*[F.abs(c) for c in col])
        axis = F.when(F.abs(col[0]) == big, 0).when(F.abs(col[1]) == big, 1).otherwise(2)
        axes.append(axis)
        signs.append(F.signum(F.when(axis == 0, col[0]).when(axis == 1, col[1]).otherwise(col[2])))
    return axes, signs


def permutation_and_flips(axes1, signs1, axes2, signs2) -> tuple[list[Column], list[Column]]:
    """Axis order that maps the second image to the first, and the axes to flip."""
    perm = []
    for a in axes1:
        hit = F.lit(-1)
        for j in range(3):  # the last match counts
            hit = F.when(axes2[j] == a, F.lit(j)).otherwise(hit)
        perm.append(hit)
    return perm, [s * t < 0 for s, t in zip(signs1, signs2)]


def rect_grid(planes: DataFrame, rows: int, cols: int, centred: bool = True) -> DataFrame:
    """Grid points of each plane spanned by u (``ux..``) and v (``vx..``), relative to its origin."""
    cut = planes.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    )
    a = F.col("col") - ((cols - 1) / 2 if centred else 0)
    b = (rows - 1 - F.col("row")) - ((rows - 1) / 2 if centred else 0)
    return cut.withColumns({f"g{c}": a * F.col(f"u{c}") + b * F.col(f"v{c}") for c in "xyz"})


def polar_grid(planes: DataFrame, angles: int, dia: int) -> DataFrame:
    """Points on ``angles`` diameters (first and last angle coincide) of ``dia`` points each."""
    cut = planes.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(dia - 1)))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))
    )
    rho = F.col("row") - (dia - 1) / 2
    theta = F.col("col") * (2 * math.pi / (angles - 1))
    a, b = rho * F.cos(theta), rho * F.sin(theta)
    return cut.withColumns({f"g{c}": a * F.col(f"u{c}") + b * F.col(f"v{c}") for c in "xyz"})


# Class ids that change.
VOXEL_RELABEL = {15: 13}
VESSEL_MERGE = {12: 5, 13: 6}


def relabel(c: Column, mapping: dict[int, int], above: int | None = None) -> Column:
    """Replace ids; ids beyond ``above`` become 0."""
    out = c
    if above is not None:
        out = F.when(c > above, F.lit(0)).otherwise(out)
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def fixed_norm(v: Column, mean: float, std: float) -> Column:
    return (v - mean) / std


def clip_range(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))


def min_max_norm(voxels: DataFrame, value: str, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    lim = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return voxels.join(lim, list(keys)).withColumn(
        "norm", F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    ).drop("_lo", "_hi")


def clipped_z_score(voxels: DataFrame, value: str, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Clip to the 0.5 and 99.5 percentiles, then score with the unclipped mean and deviation."""
    q = quantiles(voxels, keys, value, [0.005, 0.995]).groupBy(*keys).agg(
        F.min("q").alias("_lo"), F.max("q").alias("_hi")
    )
    m = voxels.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    both = voxels.join(q.join(m, list(keys)), list(keys))
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(value)))
    return both.withColumn("z_score", (clipped - F.col("_m")) / (F.col("_s") + 1e-9)).drop("_lo", "_hi", "_m", "_s")


def rescale_box(box: Sequence[Column], old: Sequence[Column], new: Sequence[float]) -> list[Column]:
    """Box z1 z2 x1 x2 y1 y2 from spacing ``old`` to ``new``, rounded half to even."""
    return [F.bround(b * old[i // 2] / new[i // 2]).cast("int") for i, b in enumerate(box)]


def roll(a: Column, by: int) -> Column:
    """Move the last ``by`` elements of an array to the front."""
    by_ = F.lit(by) % F.greatest(F.size(a), F.lit(1))
    return F.concat(F.slice(a, F.size(a) - by_ + 1, by_), F.slice(a, F.lit(1), F.size(a) - by_))


def rename_plan(files: DataFrame, name: str, image: bool = True) -> DataFrame:
    """Numbered new names for files in name order, counting on after those already named.

    ``files(file)``; a file is already named if the text before its first ``_`` is ``name``.
    """
    done = F.split_part("file", F.lit("_"), F.lit(1)) == name
    todo = ranked(files.where(~done).select("file").distinct(), [F.col("file")], "_no")
    start = files.agg(F.count_if(done).alias("_start"))
    tail = "_0000.nii.gz" if image else ".nii.gz"
    return todo.crossJoin(F.broadcast(start)).select(  # one row
        "file", F.concat(F.lit(name + "_"), F.format_string("%03d", F.col("_no") + F.col("_start")), F.lit(tail)).alias("new_name")
    )


def large_z(voxels: DataFrame, limit: float = 3.5) -> DataFrame:
    """Cases whose y extent is less than ``limit`` times the z extent."""
    size = voxels.groupBy("case_id").agg((F.max("y") + 1).alias("ny"), (F.max("z") + 1).alias("nz"))
    return size.withColumn("large_z", F.col("ny") / F.col("nz") < limit)


def crop(requests: DataFrame, voxels: DataFrame, half: Sequence[int], value: str, step: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """Patch around each centre (cx, cy, cz), zero outside the stored voxels.

    The patch runs from ``c - half`` up to, not including, ``c + half`` in steps of ``step``.
    """
    g_ = requests
    for c, h, s in zip("xyz", half, step):
        g_ = g_.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), F.lit(2 * h - 1), F.lit(s)))).withColumn(
            c, F.col(f"c{c}") - h + F.col(f"i{c}")
        )
    v = voxels.select("case_id", "x", "y", "z", F.col(value).alias("_v"))
    return g_.join(v, ["case_id", "x", "y", "z"], "left").withColumn("v", F.coalesce("_v", F.lit(0.0))).drop("_v")


def fill_back(voxels: DataFrame, patches: DataFrame, value: str) -> DataFrame:
    """Write patch values (case_id, x, y, z, v) over the voxels they lie on."""
    p = patches.groupBy("case_id", "x", "y", "z").agg(F.max("v").alias("_v"))
    return voxels.join(p, ["case_id", "x", "y", "z"], "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def expand(voxels: DataFrame, x0: int, y0: int) -> DataFrame:
    """Coordinates of a cropped image in its original frame."""
    return voxels.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0})


def padded_size(n: Column, unit: int) -> Column:
    return F.ceil(n / unit) * unit


def slice_at(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    return voxels.where(F.col(axis) == at)


def softmax_all(scores: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Softmax over the whole score matrix of a key, not per row."""
    total = scores.groupBy(*keys).agg(F.sum(F.exp(value)).alias("_t"))
    joined = scores.join(total, list(keys)) if keys else scores.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("p", F.exp(value) / F.col("_t")).drop("_t")


def one_hot(c: Column, n: int) -> Column:
    return F.array(*[(c == i).cast("int") for i in range(n)])


def soft_threshold(x: Column, gamma: float, th: float) -> Column:
    return 1 / (1 + F.exp(-gamma * (x - th)))


def contour_point(rho: Column, i: Column, n: Column, cx: float, cy: float) -> tuple[Column, Column]:
    """Point i of n at distance rho from the centre, at equal angles."""
    t = F.radians(360.0 / n * i)
    return cx + rho * F.cos(t), cy + rho * F.sin(t)
