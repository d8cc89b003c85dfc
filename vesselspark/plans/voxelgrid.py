"""Neighbourhoods in voxel tables, as equi-joins on shifted coordinates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["case_id", "x", "y", "z"]
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
TWENTY_SIX = [
    (a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)
]


def half(offsets: Iterable[tuple]) -> list[tuple]:
    """One of each pair of opposite offsets."""
    return [o for o in offsets if o > (0, 0, 0)]


def voxel_id(x="x", y="y", z="z") -> Column:
    """One integer per position; coordinates from -2^20 to 2^20 - 1."""
    return packed([F.col(c).cast("bigint") for c in (x, y, z)])


def packed(whole: list[Column]) -> Column:
    """Three integers from -2^20 to 2^20 - 1 as one; others raise, as they would collide."""
    shift = 1 << 20
    wide = [c + shift for c in whole]
    fits = F.greatest(*wide) < 2 * shift
    fits = fits & (F.least(*wide) >= 0)
    number = (wide[0] * (1 << 21) + wide[1]) * (1 << 21) + wide[2]
    return F.when(F.greatest(*wide).isNull(), F.lit(None).cast("bigint")).when(fits, number).otherwise(F.raise_error(F.lit("coordinate out of the range of packed ids")).cast("bigint"))


def with_position(df: DataFrame, node: str = "node") -> DataFrame:
    n, shift, span = F.col(node), 1 << 20, 1 << 21
    return df.withColumns({
        "x": F.shiftright(n, 42) - shift,
        "y": F.shiftright(n, 21).bitwiseAND(span - 1) - shift,
        "z": n.bitwiseAND(F.lit(span - 1)) - shift,
    })


def spread(voxels: DataFrame, offsets: Iterable[tuple], extra: str | None = None) -> DataFrame:
    """One copy of each voxel at every offset; ``extra`` names a fourth value of each offset."""
    offsets = list(offsets)
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("a", "b", "c", "d"))]) for o in offsets])
    out = voxels.withColumn("_o", F.explode(arr))
    cols = {c: F.col(c) + F.col(f"_o.{n}") for c, n in zip("xyz", "abc")}
    if extra:
        cols[extra] = F.col("_o.d")
    return out.withColumns(cols).drop("_o")


def neighbour_edges(mask: DataFrame, offsets: Iterable[tuple]) -> DataFrame:
    """Edges (case_id, src, dst) between voxels of the mask that are neighbours."""
    m = mask.select(*KEY)
    moved = spread(m.withColumn("src", voxel_id()), half(offsets))
    return moved.join(m, KEY).select("case_id", "src", voxel_id().alias("dst"))


def mask_components(mask: DataFrame, offsets: Iterable[tuple]) -> DataFrame:
    """(case_id, node, x, y, z, comp) for every voxel of the mask, ``offsets`` being ``SIX`` or ``TWENTY_SIX``; ``comp`` is the piece's least node.

    Voxels of a line that touch are one node; runs of neighbouring lines are joined, so that a voxel
    is not copied to its neighbours.
    """
    from ..session import stored
    from .graphloop import components

    if set(offsets) == set(SIX):
        lines, reach = [(0, 1), (1, 0)], 0
    elif set(offsets) == set(TWENTY_SIX):
        lines, reach = [(0, 1), (1, -1), (1, 0), (1, 1)], 1
    else:
        raise ValueError("pieces are 6- or 26-connected")
    along = Window.partitionBy("case_id", "x", "y")
    placed = mask.select(*KEY).withColumn("_run", F.col("z") - F.dense_rank().over(along.orderBy("z")))
    placed = placed.withColumn("z0", F.min("z").over(Window.partitionBy("case_id", "x", "y", "_run"))).drop("_run")
    placed = stored(placed, "runs")
    run = placed.groupBy("case_id", "x", "y", "z0").agg(F.max("z").alias("z1"))
    # Edges of one cube come together, so that contraction inside a partition leaves little to join.
    cube = [F.shiftright(F.col(c), 5) for c in "xyz"]
    edges = with_position(run_edges(run, ["case_id"], lines, reach), "src").repartition("case_id", *cube)
    start = voxel_id("x", "y", "z0").alias("node")
    label = components(edges.select("case_id", "src", "dst"), run.select("case_id", start)).withColumnRenamed("node", "_run")
    at = placed.withColumn("_run", start)
    return at.join(label, ["case_id", "_run"]).select("case_id", voxel_id().alias("node"), "x", "y", "z", "comp")


def surface(mask: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Voxels of the mask with at least one of six neighbours outside it."""
    at = [*keys, "x", "y", "z"]
    m = mask.select(*at)
    inside = spread(m, SIX).groupBy(*at).agg(F.count("*").alias("_n")).where("_n = 6").drop("_n")
    return m.join(inside, at, "left_anti")


# -- runs ------------------------------------------------------------------------------

#: Length of the pieces of a line in which runs look for each other.
PIECE = 64


def runs(mask: DataFrame, keys: Iterable[str] = ("case_id",)) -> DataFrame:
    """Maximal runs along z of the voxels of each key: (keys, x, y, z0, z1)."""
    line = [*keys, "x", "y"]
    w = Window.partitionBy(*line).orderBy("z")
    placed = mask.select(*line, "z").distinct().withColumn("_run", F.col("z") - F.row_number().over(w))
    return placed.groupBy(*line, "_run").agg(F.min("z").alias("z0"), F.max("z").alias("z1")).drop("_run")


def run_edges(lines: DataFrame, keys: Iterable[str], offsets: Iterable[tuple], reach: int) -> DataFrame:
    """Pairs of runs in lines apart by an offset whose z ranges come within ``reach``: (keys, src, dst), by their first voxels."""
    keys = list(keys)
    a = lines.select(*keys, "x", "y", F.col("z0").alias("a0"), F.col("z1").alias("a1"), voxel_id("x", "y", "z0").alias("src"))
    arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in offsets])
    a = a.withColumn("_o", F.explode(arr)).withColumns({"x": F.col("x") + F.col("_o.p"), "y": F.col("y") + F.col("_o.q")}).drop("_o")
    piece = lambda c: F.floor(c / PIECE)
    a = a.withColumn("_piece", F.explode(F.sequence(piece(F.col("a0") - reach), piece(F.col("a1") + reach))))
    b = lines.select(*keys, "x", "y", "z0", "z1", voxel_id("x", "y", "z0").alias("dst")).withColumn("_piece", F.explode(F.sequence(piece(F.col("z0")), piece(F.col("z1")))))
    near = (F.col("a0") - reach <= F.col("z1")) & (F.col("z0") <= F.col("a1") + reach)
    # A pair meets in every piece that both reach: it counts in the first.
    first = F.col("_piece") == piece(F.greatest(F.col("a0") - reach, F.col("z0")))
    return a.join(b, [*keys, "x", "y", "_piece"]).where(near & first).select(*keys, "src", "dst")
