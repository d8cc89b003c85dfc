"""Ordered operators give the same rows for any block size."""

import numpy as np
import pytest
from conftest import SCHEMA, walk

from vesselspark.operators import traces as tr
from vesselspark.operators.cutting import intensity_cuts
from vesselspark.operators.frames import rotation_frames
from vesselspark.plans.blocks import quantiles, ranked, running
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def p(spark):
    return spark.createDataFrame(walk(1, 150) + walk(2, 90, trace_id=1), SCHEMA)


def table(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


OPS = [
    lambda p, s: tr.accumulated_length(p, s).select("trace_id", "seq", "acc"),
    lambda p, s: tr.tangent(p, True, s).select("trace_id", "seq", "tx", "ty", "tz"),
    lambda p, s: tr.moving_average(p, 5, s).select("trace_id", "seq", "x", "rad"),
    lambda p, s: tr.trim_end_radius(p, 1.1, s).select("trace_id", "seq", "rad"),
    lambda p, s: tr.remove_self_loop(p, s).select("trace_id", "seq", "x", "y", "z"),
    lambda p, s: tr.resample(p, 0.7, s).select("trace_id", "seq", "x", "y", "z"),
    lambda p, s: tr.resample_at_slices(p, s).select("trace_id", "seq", "x", "y"),
    lambda p, s: tr.resample_along_axis(p, size=s).select("trace_id", "seq", "x", "y"),
    lambda p, s: tr.position_energy(p, 5, s).select("trace_id", "energy"),
    lambda p, s: intensity_cuts(p, "rad", nstd=1.2, size=s).select("trace_id", "piece", "seq", "x"),
]


@pytest.mark.parametrize("i", range(len(OPS)))
def test_block_size_does_not_matter(p, i):
    assert table(OPS[i](p, 16)) == table(OPS[i](p, 65536))


def test_frames_equal_a_plain_loop(spark):
    p = spark.createDataFrame(walk(3, 60), SCHEMA)
    p = tr.remove_duplicate_points(p)
    rows = rotation_frames(p, 16).orderBy("seq").collect()
    x = np.array([(r.x, r.y, r.z) for r in rows])
    step = np.diff(x, axis=0)
    step /= np.linalg.norm(step, axis=1)[:, None]
    t = np.vstack([step[:1], step[1:] + step[:-1], step[-1:]])
    n = np.linalg.norm(t, axis=1)[:, None]
    t = np.divide(t, n, out=np.zeros_like(t), where=n > 0)
    prev, acc = np.array([1.0, 0, 0]), np.eye(3)
    for r, cur in zip(rows, t):
        k = np.cross(prev, cur)
        skew = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        acc = (np.eye(3) + skew + skew @ skew * (1 - prev @ cur) / max(k @ k, 1e-10)) @ acc
        u = acc[:, 1] / np.linalg.norm(acc[:, 1])
        assert np.allclose(u, (r.ux, r.uy, r.uz), atol=1e-6)
        prev = cur


def test_quantiles_and_ranks(spark):
    v = np.random.default_rng(0).integers(0, 40, 500)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "k int, v double")
    got = {(r.k, r.p): r.q for r in quantiles(df, ["k"], "v", [0.0, 0.3, 0.998, 1.0], size=12).collect()}
    for k in (0, 1):
        for q in (0.0, 0.3, 0.998, 1.0):
            assert got[(k, q)] == pytest.approx(np.quantile(v[k::2], q))
    ids = spark.range(300).select((F.col("id") * 37 % 300).alias("n"))
    assert all(r.n + 1 == r["rank"] for r in ranked(ids, [F.col("n")], parts=7).collect())


def test_values_between_0_and_1_fill_many_blocks(spark, monkeypatch):
    from vesselspark import session
    from vesselspark.operators import evaluation as ev

    kept, made = session.stored, []
    monkeypatch.setattr(session, "stored", lambda df, label="stage": made.append((label, out := kept(df, label))) or out)
    rng = np.random.default_rng(1)
    # One key holds nearly all rows, close together.
    rows = [("a", float(v), int(i % 3 == 0)) for i, v in enumerate(rng.uniform(0.4, 0.4001, 1000))] + [(k, 0.5, 1) for k in "bcd"]
    df = spark.createDataFrame(rows, "k string, score double, y int")
    got = {(r.k, r.p): r.q for r in quantiles(df, ["k"], "score", [0.1, 0.5], size=50).collect()}
    values = [v for k, v, _ in rows if k == "a"]
    assert got == {("a", q): pytest.approx(np.quantile(values, q), abs=1e-12) for q in (0.1, 0.5)} | {(k, q): 0.5 for k in "bcd" for q in (0.1, 0.5)}
    ranges = [t for label, t in made if label == "ranges"]
    per = [r["count"] for r in ranges[0].where("k = 'a'").groupBy("_range").count().collect()]
    assert len(per) > 10 and max(per) < 150
    assert table(ev.roc_curve(df, 40)) == table(ev.roc_curve(df)) and table(ev.pr_curve(df, 40)) == table(ev.pr_curve(df))
    assert quantiles(df.limit(0), ["k"], "score", [0.5]).count() == 0


def test_running_maximum(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "k int, i long, v double")
    got = [r.m for r in running(df, ["k"], "i", {"m": F.col("v")}, how="max", size=3).orderBy("i").collect()]
    assert got == [3, 3, 4, 4, 5, 9, 9, 9]
