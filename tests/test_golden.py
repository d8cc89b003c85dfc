"""Hand-made cases with known results."""

import itertools
import math
import random

import pytest
from conftest import points
from pyspark.sql import functions as F

from vesselspark.functions.lookups import end_rules
from vesselspark.operators import evaluation as ev, matching as mt, traces as tr
from vesselspark.sources.settings import contour_area


def test_straight_and_bent_line(spark):
    p = points(spark, [[(0, 0, 0), (3, 4, 0)], [(0, 0, 0), (3, 0, 0), (3, 4, 0)]])
    a, b = tr.trace_features(p).orderBy("trace_id").collect()
    assert a.length == 5 and a.tortuosity == 1 and a.volume == pytest.approx(5 * math.pi)
    assert b.length == 7 and b.tortuosity == pytest.approx(7 / 5)


def test_closed_trace_has_no_tortuosity(spark):
    p = points(spark, [[(0, 0, 0), (1, 0, 0), (0, 0, 0)]])
    assert tr.trace_features(p).first().tortuosity is None


@pytest.mark.parametrize("gap,n", [(1, 5), (3, 3)])
def test_resample(spark, gap, n):
    p = points(spark, [[(0, 0, 0), (3, 4, 0)]])
    rows = tr.resample(p, gap).orderBy("seq").collect()
    assert len(rows) == n
    assert (rows[0].x, rows[-1].x, rows[-1].y) == (0, 3, 4)
    assert rows[1].x == pytest.approx(3 / (n - 1))


def test_self_loop(spark):
    a, b, c, d = (0, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0)
    rows = tr.remove_self_loop(points(spark, [[a, b, c, b, d]])).orderBy("seq").collect()
    assert [(r.seq, r.x, r.y) for r in rows] == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]


def test_end_rules():
    rule = {(a, b): v for a, b, v in end_rules()}
    assert rule[(3, 7)] == 3 and rule[(7, 3)] == 3 and (1, 2) not in rule


def test_trilinear(spark):
    vox = spark.createDataFrame(
        [(1, x, y, z, float(4 * x + 2 * y + z)) for x in (0, 1) for y in (0, 1) for z in (0, 1)], "case_id long, x long, y long, z long, v double"
    )
    at = [(0, 0, 1), (0, 0.25, 0.5), (1, 1, 1), (1, 0.5, 0.25)]
    q = points(spark, [at])
    got = [r.v for r in mt.sample(q, vox, "v", ["case_id", "seq"]).orderBy("seq").collect()]
    assert got == pytest.approx([1, 1, 7, 5.25])


def test_unit_square(spark):
    c = spark.createDataFrame([(1, 1, "a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])],
                              "case_id int, slice_no int, kind string, seq long, px double, py double")
    assert contour_area(c).first().area == 1


def test_betti(spark):
    shell = [(1, x, y, z) for x in range(3) for y in range(3) for z in range(3) if (x, y, z) != (1, 1, 1)]
    ring = [(2, x, y, 0) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    m = spark.createDataFrame(shell + ring + [(3, 5, 5, 5)], "case_id long, x long, y long, z long")
    got = {r.case_id: (r.b0, r.b1, r.b2) for r in ev.betti(m).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 0), 3: (1, 0, 0)}


def plain_betti(mask):
    """b0, b1, b2 of a set of voxels by flooding the padded box and counting cells."""
    def pieces(cells, near):
        left, n = set(cells), 0
        while left:
            stack, n = [left.pop()], n + 1
            while stack:
                p = stack.pop()
                for o in near:
                    q = tuple(a + b for a, b in zip(p, o))
                    if q in left:
                        left.remove(q)
                        stack.append(q)
        return n

    all_ = list(itertools.product((-1, 0, 1), repeat=3))
    box = itertools.product(*(range(min(p[i] for p in mask) - 1, max(p[i] for p in mask) + 2) for i in range(3)))
    b0 = pieces(mask, all_)
    b2 = pieces(set(box) - mask, [o for o in all_ if sum(map(abs, o)) == 1]) - 1
    cells = {tuple(2 * a + b for a, b in zip(p, o)) for p in mask for o in all_}
    euler = sum((-1) ** sum(c % 2 == 0 for c in cell) for cell in cells)
    return b0, b0 + b2 - euler, b2


def test_betti_of_random_masks(spark):
    rng = random.Random(5)
    masks = {c: {p for p in itertools.product(range(5), range(5), range(5)) if rng.random() < share} for c, share in enumerate((0.1, 0.3, 0.5, 0.7, 0.85, 0.95))}
    # Lines over several pieces, with a gap between them that stays closed and one that opens far away.
    masks[10] = {(x, y, z) for x in range(3) for y in range(3) for z in range(-70, 200)} - {(1, 1, z) for z in range(-60, 190)}
    masks[11] = masks[10] - {(0, 1, 150)}
    rows = [(c, *p) for c, m in masks.items() for p in m]
    m = spark.createDataFrame(rows, "case_id long, x long, y long, z long")
    got = {r.case_id: (r.b0, r.b1, r.b2) for r in ev.betti(m).collect()}
    assert got == {c: plain_betti(m) for c, m in masks.items()}
    assert got[10][2] == 1 and got[11][2] == 0
    assert ev.betti(m.limit(0)).count() == 0


def test_betti_errors_of_labels(spark):
    rows = [(1, 0, 0, 0, 1, 1), (1, 4, 0, 0, 1, 0), (1, 8, 0, 0, 2, 2), (1, 8, 4, 0, 0, 3), (2, 0, 0, 0, 0, 0)]
    v = spark.createDataFrame(rows, "case_id long, x long, y long, z long, gt long, pred long")
    got = {(r.case_id, r.label): (r.err_b0, r.err_b1) for r in ev.betti_errors(v).collect()}
    assert got == {(1, "1"): (1, None), (1, "2"): (0, None), (1, "3"): (1, None), (1, "average"): (2 / 3, None), (1, "merged"): (0, 0), (2, "average"): (0, None), (2, "merged"): (0, 0)}


def test_empty_masks(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 0, 0)], "case_id long, x long, y long, z long, gt long, pred long")
    assert ev.dice(v).first().dice == 1
    got = {r.label: r.dice for r in ev.dice_per_class(v).collect()}
    assert got == {"average": 0, "merged": 0}


def test_slice_true_negatives(spark):
    v = spark.createDataFrame([(1, 0, 0, z, g, p) for z, g, p in ((0, 1, 1), (1, 0, 0), (2, 1, 0))], "case_id long, x long, y long, z long, gt long, pred long")
    assert ev.slice_confusion(v).first().tn == 1
    assert ev.slice_confusion(v, ref_tn=True).first().tn == 2


def test_critical_voxels(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 1, 0, 0, 2), (1, 5, 0, 0, 1)], "case_id long, x long, y long, z long, label long")
    assert sorted(r.x for r in ev.critical_voxels(v, 1, 2, False).select(F.col("x")).collect()) == [0, 1]


def test_medoids_compare_few_pairs(spark, monkeypatch):
    from vesselspark.operators import volumes as vol

    kept, made = vol.stored, {}
    monkeypatch.setattr(vol, "stored", lambda df, label="stage": made.setdefault(label, kept(df, label)))
    rng = random.Random(6)
    blob = {(x, y, z) for x in range(14) for y in range(12) for z in range(10) if rng.random() < 0.8}
    line = {(100 + i, 50 + i // 2, 3) for i in range(60)}
    lone = {(200, 0, 0)}
    m = spark.createDataFrame([(1, *p) for p in blob | line | lone] + [(2, *p) for p in line], "case_id long, x long, y long, z long")
    got = {(r.case_id, r.x, r.y, r.z) for r in vol.medoids(m, cap=300).collect()}
    want = lambda piece: min(piece, key=lambda p: (round(sum(math.dist(p, q) for q in piece), 6), p))
    assert {(1, *want(line)), (1, *want(lone)), (2, *want(line))} < got
    assert (1, *want(max(pieces_of(blob), key=len))) in got
    assert made["candidates"].where("case_id = 1 and x < 50").count() < len(blob) / 10


def pieces_of(cells):
    left, out = set(cells), []
    while left:
        stack, piece = [left.pop()], []
        while stack:
            p = stack.pop()
            piece.append(p)
            for o in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(a + b for a, b in zip(p, o))
                if q in left:
                    left.remove(q)
                    stack.append(q)
        out.append(piece)
    return out
