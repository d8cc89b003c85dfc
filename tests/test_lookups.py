"""Voxels looked up by cubes, against plain loops."""

import itertools
import math
import random

import pytest
from conftest import SCHEMA

from vesselspark.operators import matching as mt
from vesselspark.plans import cubes

VOXELS = "case_id long, x int, y int, z int, v double"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    # Cubes end at multiples of 32: positions lie on both sides of 0 and 32, whole and broken ones.
    points = [(1 + i % 2, 7, i, *(rng.choice([-1.0, 0.0, 31.0, 31.5, 32.0]) + rng.choice([0.0, rng.uniform(-2, 2)]) for _ in range(3)), 1.0) for i in range(60)]
    span = [-4, -3, -2, -1, 0, 1, 2, 29, 30, 31, 32, 33, 34, 35]
    voxels = [(c, x, y, z, float(rng.randint(1, 9))) for c in (1, 2) for x, y, z in itertools.product(span, repeat=3) if rng.random() < 0.7]
    return points, spark.createDataFrame(points, SCHEMA), {v[:4]: v[4] for v in voxels}, spark.createDataFrame(voxels, VOXELS)


def _linear(grid, case, at):
    low = [math.floor(c) for c in at]
    return sum(
        grid.get((case, *(n + d for n, d in zip(low, o))), 0.0) * math.prod(c - n if d else 1 - (c - n) for c, n, d in zip(at, low, o))
        for o in itertools.product((0, 1), repeat=3)
    )


@pytest.mark.parametrize("limit", [100_000, 4])
def test_lookups_by_cubes_equal_loops(spark, tables, monkeypatch, limit):
    monkeypatch.setattr(cubes.by_cubes, "__defaults__", (limit,))
    points, p, grid, vox = tables
    ids = ["case_id", "seq"]
    got = {(r.case_id, r.seq): r.v for r in mt.sample(p, vox, "v", ids).collect()}
    assert got == {(c, s): pytest.approx(_linear(grid, c, at)) for c, _, s, *at, _ in points}
    for ball in (False, True):
        offs = [o for o in itertools.product((-1, 0, 1), repeat=3) if not ball or sum(n * n for n in o) <= 1]
        got = {(r.case_id, r.seq): r.v for r in mt.mean_around(p, vox, "v", ids, 1, ball).collect()}
        want = {(c, s): sum(_linear(grid, c, [a + n for a, n in zip(at, o)]) for o in offs) / len(offs) for c, _, s, *at, _ in points}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    got = {(r.case_id, r.seq): r.fit_rad for r in mt.radius_from_mask(p, vox, ids).collect()}
    axes = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
    for c, _, s, *at, _ in points:
        count = {r: sum((c, *(round(a + r * n) for a, n in zip(at, o))) in grid for o in axes) for r in range(1, 10)}
        assert got[c, s] == next((pytest.approx(r + n / 6) for r, n in count.items() if n < 3), 9.0)


def test_offsets_and_corners_make_no_rows(tables):
    _, p, _, vox = tables
    ids = ["case_id", "seq"]
    for out in (mt.mean_around(p, vox, "v", ids), mt.mean_around(p, vox, "v", ids, 1, True), mt.radius_from_mask(p, vox, ids), mt.sample(p, vox, "v", ids)):
        assert "explode([[" not in _plan(out)
