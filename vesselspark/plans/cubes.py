"""Looking up voxels at many positions, by cubes.

Voxels are dealt out by cubes, with the copies that positions near an edge need; a row with positions goes to the
cubes that its positions lie in.  Nothing is shuffled for each voxel that is looked at: inside a cube
the voxels are a dense grid of bounded size, and lookups are numpy indexing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .grid import _split_crowded

#: Edge of a cube in voxels.
CUBE = 32
#: Rows with positions that one group may hold before its cube is split.
GROUP_ROWS = 100_000
AT_CUBE = ["_cx", "_cy", "_cz"]


def in_cube(at: Sequence) -> list:
    """Cube numbers of a position, 0 where it is null."""
    return [F.coalesce(F.floor(F.floor(c) / CUBE), F.lit(0)) for c in at]


def by_cubes(
    rows: DataFrame, voxels: DataFrame, value: str, reach: int,
    look: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, limit: int = GROUP_ROWS,
) -> DataFrame:
    """``look(rows, grid, low)`` for the rows of every cube (``case_id``, ``_cx``, ``_cy``, ``_cz``).

    ``grid`` holds ``value``, 0 where there is none, from ``reach`` voxels before the cube up to ``reach`` behind it;
    ``low`` is the voxel at its corner.  Cubes with more than ``limit`` rows are split, their voxels copied.
    """
    on = ["case_id", *AT_CUBE]
    vox = voxels.where(F.col("case_id").isNotNull()).select(
        "case_id", *[F.col(c).cast("bigint").alias(f"_v{c}") for c in "xyz"], F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value")
    )
    for c, v in zip(AT_CUBE, ("_vx", "_vy", "_vz")):
        vox = vox.withColumn(c, F.explode(F.sequence(F.floor((F.col(v) - reach) / CUBE), F.floor((F.col(v) + reach) / CUBE))))
    vox, rows, on = _split_crowded(vox, rows, on, limit)
    side = CUBE + 2 * reach

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        low = np.array([k.as_py() for k in key[1:4]], dtype=np.int64) * CUBE - reach
        grid = np.zeros((side, side, side))
        if right.num_rows and left.num_rows:
            np.add.at(grid, tuple(right[f"_v{c}"].to_numpy() - low[i] for i, c in enumerate("xyz")), right["_value"].to_numpy())
        return look(left, grid, low)

    # Cubes without rows are left out before they are sent.
    wanted = rows.select(*on).distinct()
    vox = vox.join(wanted, on, "left_semi")
    # Both sides may stem from one frame: named anew, their columns are told apart.
    rows, vox = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (rows, vox))
    return rows.groupBy(*on).cogroup(vox.groupBy(*on)).applyInArrow(run, schema)


def interpolated(grid: np.ndarray, low: np.ndarray, at: np.ndarray, offsets: Sequence[tuple[int, int, int]] = ((0, 0, 0),)) -> np.ndarray:
    """Sum over ``offsets`` of the linearly interpolated values at ``at + offset``; NaN where a position is not finite.

    A voxel that several offsets meet is looked up once, with the sum of its weights.
    """
    fine = np.isfinite(at).all(axis=1)
    base = np.floor(np.where(fine[:, None], at, (low + grid.shape[0] // 2).astype(float)))
    part = np.where(fine[:, None], at, base) - base
    here = base.astype(np.int64) - low
    share = [(1 - part[:, i], part[:, i]) for i in range(3)]
    shifts: dict[tuple, list[tuple]] = {}
    for o in offsets:
        for corner in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)):
            shifts.setdefault(tuple(m + n for m, n in zip(o, corner)), []).append(corner)
    weight = {(a, b, c): share[0][a] * share[1][b] * share[2][c] for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    total = np.zeros(len(at))
    for s, corners in shifts.items():
        w = sum(weight[c] for c in corners)
        v = grid[here[:, 0] + s[0], here[:, 1] + s[1], here[:, 2] + s[2]]
        total += np.where(w > 0, w * v, 0.0)  # a voxel without weight does not count, whatever it holds
    total[~fine] = np.nan
    return total


def positions(table: pa.Table, names: Sequence[str] = ("x", "y", "z")) -> np.ndarray:
    """Positions of the rows, NaN where one is null."""
    return np.stack([table[c].to_numpy().astype(float) for c in names], axis=1)
