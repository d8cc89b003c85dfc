"""Queries near traces by cell boxes, against all pairs."""

import math
import random

from conftest import SCHEMA, points
from pyspark.sql import functions as F

from vesselspark import session
from vesselspark.operators import matching as mt


def test_points_in_traces_equal_all_pairs(spark):
    rng = random.Random(1)
    a, b = ([(1 + t % 2, t, i, *(rng.choice([0.0, 0.5, 1.0]) + rng.uniform(0, 12) for _ in range(3)), 1.0) for t in range(6) for i in range(30)] for _ in range(2))
    for r in (0.6, 3.0):
        want = {x[:3] for x in a for y in b if x[0] == y[0] and math.dist(x[3:6], y[3:6]) < r}
        got = mt.in_traces(mt.as_queries(spark.createDataFrame(a, SCHEMA)), spark.createDataFrame(b, SCHEMA), r).collect()
        assert {(x["case_id"], x["q_trace_id"], x["q_seq"]) for x in got} == want and len(got) == len(want)


def test_boxes_keep_pairs_few_where_points_are_dense(spark, monkeypatch):
    rows = [(1, t, i, i * 0.05, 0.4 * t, 0.01 * math.sin(i + t), 1.0) for t in range(8) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    made = []
    kept = session.stored
    monkeypatch.setattr(session, "stored", lambda df, label="stage": made.append(out := kept(df, label)) or out)
    # Nearly all 400 x 2,800 pairs lie within the reach.
    assert mt.in_traces(mt.as_queries(frame.where("trace_id = 0")), frame.where("trace_id > 0"), 5.0).count() == 400
    assert sum(df.count() for df in made) < 2 * len(rows)


def test_queries_named_by_a_struct_with_a_literal(spark):
    p = points(spark, [[(x, 0, 0) for x in range(6)], [(x, 3, 0) for x in range(6)]])
    q = p.where("trace_id = 0").select("case_id", F.lit(1).cast("bigint").alias("trace_id"), F.struct("seq", F.lit(0).alias("new")).alias("q_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    got = mt.nearest_in_trace(q, p, 5.0).collect()
    assert sorted((r.q_id.seq, r.q_id.new, r.seq, r.dist) for r in got) == [(i, 0, i, 3.0) for i in range(6)]
