"""The nearest point in each trace, and traces near by boxes, against all pairs."""

import math
import random

import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from vesselspark import session
from vesselspark.operators import matching as mt
from vesselspark.operators.points import path, path_sets
from vesselspark.plans import grid


def _rows(rng):
    # Positions on halves: many points are equally far.
    return [(1 + t % 2, t, i, *(rng.choice([0.0, 0.5, 1.0, 1.5]) + 6 * rng.randint(0, 1) for _ in range(3)), 1.0) for t in range(6) for i in range(25)]


@pytest.mark.parametrize("limit", [200_000, 7])
def test_nearest_of_each_trace_equals_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(grid.nearest_in_groups, "__defaults__", (("case_id",), False, limit))
    rows = _rows(random.Random(5))
    frame = spark.createDataFrame(rows, SCHEMA)
    for r in (0.6, 3.0):
        want = {}
        for a in rows:
            for b in rows:
                d = math.dist(a[3:6], b[3:6])
                if a[0] == b[0] and a[1] != b[1] and d < r:
                    k = (*a[:3], b[1])
                    want[k] = min(want.get(k, (d, b[2])), (d, b[2]))
        got = mt.nearest_per_trace(mt.as_queries(frame), frame, r).collect()
        assert {(x.case_id, x.q_trace_id, x.q_seq, x.trace_id): (x.dist, x.seq) for x in got} == want and len(got) == len(want)
    q = frame.select("case_id", F.lit(3).cast("bigint").alias("trace_id"), F.struct("trace_id", "seq").alias("q_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"]).where("case_id = 2")
    want = {a[1:3]: min((math.dist(a[3:6], b[3:6]), b[2]) for b in rows if b[1] == 3) for a in rows if a[0] == 2}
    got = {tuple(x.q_id): (x.dist, x.seq) for x in mt.nearest_in_trace(q, frame, 1.5).collect()}
    assert got == {k: v for k, v in want.items() if v[0] <= 1.5}


def test_nearest_of_each_trace_makes_no_pairs(spark):
    frame = spark.createDataFrame(_rows(random.Random(6)), SCHEMA)
    plan = mt.nearest_per_trace(mt.as_queries(frame), frame, 3.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_dense_queries_meet_targets_as_boxes(spark, monkeypatch):
    rows = [(1, t, i, i * 0.01, 0.4 * t, 0.01 * math.sin(i + t), 1.0) for t in range(8) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    made, kept = [], session.stored
    monkeypatch.setattr(session, "stored", lambda df, label="stage": made.append(out := kept(df, label)) or out)
    q = mt.as_queries(frame.where("trace_id = 0")).select("case_id", *mt.AT, F.col("q_trace_id"))
    near = grid.near_groups(q, frame.where("trace_id > 0"), 5.0, mt.AT, ["q_trace_id"], keys=["case_id"])
    assert near.count() == 1 and sum(df.count() for df in made) < 100


def test_values_of_sets_equal_values_of_rows(spark):
    rng = random.Random(7)
    links = spark.createDataFrame([(1, i, *(rng.uniform(20, 44) for _ in range(6))) for i in range(12)], "case_id long, id int, ax double, ay double, az double, bx double, by double, bz double")
    vox = spark.createDataFrame([(1, x, y, z, float(x * y % 7)) for x in range(20, 45) for y in range(20, 45) for z in range(20, 45)], "case_id long, x int, y int, z int, v double")
    ids = ["case_id", "id"]
    one = {(r.id, r.k): r.v for r in mt.sample(path(links), vox, "v", [*ids, "k"]).collect()}
    many = mt.sample_sets(path_sets(links), vox, "v", ids, "k").collect()
    assert {(r.id, r.k): pytest.approx(r.v) for r in many} == one and len(many) == len(one)
