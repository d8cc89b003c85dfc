"""Connected pieces of voxel masks."""

import random

import pytest

from vesselspark.plans import voxelgrid
from vesselspark.plans.voxelgrid import SIX, TWENTY_SIX, mask_components


def plain(at, offsets):
    """Least voxel of each voxel's piece."""
    out = {}
    for first in sorted(at):
        if first in out:
            continue
        out[first], todo = first, [first]
        while todo:
            x, y, z = todo.pop()
            for a, b, c in offsets:
                near = (x + a, y + b, z + c)
                if near in at and near not in out:
                    out[near] = first
                    todo.append(near)
    return out


@pytest.mark.parametrize("offsets", [SIX, TWENTY_SIX])
def test_pieces_equal_a_flood_fill_and_copy_no_voxel_to_its_neighbours(spark, offsets, monkeypatch):
    rng = random.Random(2)
    cases = {1: {(rng.randrange(-9, 9), rng.randrange(40), rng.randrange(-70, 5)) for _ in range(4000)},
             2: {(3, 4, z) for z in range(-200, 200) if z not in (0, 7)} | {(4, 5, 0), (4, 4, 7)}, 3: {(0, 0, 0)}}
    monkeypatch.setattr(voxelgrid, "spread", None)
    m = spark.createDataFrame([(c, *v) for c, at in cases.items() for v in at], "case_id long, x long, y long, z long")
    got = mask_components(m, offsets).collect()
    assert len(got) == sum(map(len, cases.values()))
    node = {(r["case_id"], r["x"], r["y"], r["z"]): r["node"] for r in got}
    want = {c: plain(at, offsets) for c, at in cases.items()}
    assert all(r["comp"] == node[(r["case_id"], *want[r["case_id"]][(r["x"], r["y"], r["z"])])] for r in got)
    assert mask_components(m.limit(0), offsets).count() == 0
