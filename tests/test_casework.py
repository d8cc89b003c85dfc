"""Cases that fit into a task are solved there, with the results of the rounds of joins."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vesselspark.operators import editing as ed, evaluation as ev, labelling as lb
from vesselspark.plans import casework, graphloop as gl


def _edges(spark, seed, cases=3, nodes=24, links=34):
    rng, rows = random.Random(seed), []
    for c in range(cases):
        for _ in range(links):
            a, b = rng.sample(range(nodes), 2)
            rows.append((c, a, b, rng.choice([0.5, 1.0, 1.25, 2.0])))
    return spark.createDataFrame(rows, "case_id long, src long, dst long, w double")


def _both(monkeypatch, build):
    """Sorted rows of a frame, solved in tasks and in rounds."""
    out = []
    for rows in (casework.CASE_ROWS, 0):
        monkeypatch.setattr(casework, "CASE_ROWS", rows)
        out.append(sorted(map(repr, (r.asDict() for r in build().collect()))))
    assert out[0]
    return out


def _tables(monkeypatch, build):
    """How many tables a step writes."""
    made = []
    for module in (gl, casework, lb):
        monkeypatch.setattr(module, "stored", lambda df, label="stage", old=module.stored: made.append(label) or old(df, label))
    return build().count(), len(made)


def test_components_and_forest(spark, monkeypatch):
    e = _edges(spark, 1, links=20)
    a, b = _both(monkeypatch, lambda: gl.components(e))
    assert a == b
    a, b = _both(monkeypatch, lambda: gl.spanning_forest(e))
    assert a == b


def test_rooted(spark, monkeypatch):
    e = gl.spanning_forest(_edges(spark, 2)).select("case_id", "src", "dst")
    top = gl.components(e).groupBy("case_id", "comp").agg(F.max("node").alias("node")).select("case_id", "node")
    a, b = _both(monkeypatch, lambda: gl.rooted(e, top))
    assert a == b
    with pytest.raises(Exception, match="no root"):
        gl_rows = top.limit(0)
        monkeypatch.setattr(casework, "CASE_ROWS", 1000)
        gl.rooted(e, gl_rows).count()


def test_fewest_hops(spark, monkeypatch):
    e = _edges(spark, 3)
    ask = spark.createDataFrame([(c, s) for c in range(3) for s in (0, 5, 99)], "case_id long, source long")
    a, b = _both(monkeypatch, lambda: gl.fewest_hops(e, ask).select("case_id", "source", "node", "hops", "path"))
    assert a == b
    monkeypatch.setattr(casework, "CASE_ROWS", 1000)
    monkeypatch.setattr(casework, "PATH_NODES", 3)
    assert sorted(map(repr, (r.asDict() for r in gl.fewest_hops(e, ask).select("case_id", "source", "node", "hops", "path").collect()))) == a


def test_reachable(spark, monkeypatch):
    e = _edges(spark, 4, nodes=30, links=40).select("case_id", "src", "dst").where("src < dst").distinct()
    both = e.select("case_id", F.col("src").alias("node")).unionByName(e.select("case_id", F.col("dst").alias("node")))
    deg = both.groupBy("case_id", "node").agg(F.count("*").alias("deg"))
    start = spark.createDataFrame([(c, q, r, n) for c in range(3) for q, r, n in (("a", 1, 2), ("a", 3, 4), ("b", 1, 7))], "case_id long, q string, root long, node long")
    shut = spark.createDataFrame([(c, q, n) for c in range(3) for q, n in (("a", 9), ("b", 11), ("b", 11))], "case_id long, q string, node long")
    gate = spark.createDataFrame([(c, r, n, n % 4 != 0) for c in range(3) for r in (1, 3) for n in range(20)], "case_id long, root long, node long, ok boolean")
    for g in (None, gate):
        a, b = _both(monkeypatch, lambda: lb.reachable(e, deg, start, shut, g))
        assert a == b


def test_distances_within(spark, monkeypatch):
    e = _edges(spark, 5)
    ask = spark.createDataFrame([(c, s, n, 2.0 + n / 8) for c in range(3) for s in (0, 3, 6) for n in range(24)], "case_id long, source long, node long, most double")
    a, b = _both(monkeypatch, lambda: gl.distances_within(e, ask).select("case_id", "source", "node", "dist"))
    assert a == b


def test_tables_do_not_follow_the_length(spark, monkeypatch):
    chain = spark.range(300).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    ask = spark.createDataFrame([(1, 0)], "case_id long, source long")
    rows, made = _tables(monkeypatch, lambda: gl.fewest_hops(chain, ask))
    assert rows == 301 and made <= 4
    pair = spark.createDataFrame([(1, 0, 250, 260.0)], "case_id long, source long, node long, most double")
    rows, made = _tables(monkeypatch, lambda: gl.distances_within(chain, pair))
    assert rows == 1 and made <= 4
    rows, made = _tables(monkeypatch, lambda: gl.spanning_forest(chain))
    assert rows == 300 and made <= 3
    rows, made = _tables(monkeypatch, lambda: gl.rooted(chain.select("case_id", "src", "dst"), ask.select("case_id", F.col("source").alias("node"))))
    assert rows == 301 and made <= 3


def _crossing(spark):
    """Traces on a coarse lattice, so that ends lie on others; at least one end meets the inside of a trace."""
    rng, rows = random.Random(7), []
    for c in range(4):
        for t in range(7):
            at = [rng.randrange(3) for _ in range(3)]
            for k in range(rng.randrange(1, 9)):
                rows.append((c, t, k, *map(float, at), float(k % 3)))
                at[rng.randrange(3)] += rng.choice([-1, 1])
    return spark.createDataFrame(rows, "case_id long, trace_id long, seq long, x double, y double, z double, rad double")


def test_transfer(spark, monkeypatch):
    p = _crossing(spark)
    a, b = _both(monkeypatch, lambda: ed.transfer(p, "length"))
    assert a == b and a != sorted(map(repr, (r.asDict() for r in p.collect())))
    monkeypatch.setattr(casework, "CASE_ROWS", 1000)
    made = []
    for module in (ed, casework):
        monkeypatch.setattr(module, "stored", lambda df, label="stage", old=module.stored: made.append(label) or old(df, label))
    assert ed.transfer(p, "length").count() == p.count() and len(made) <= 2


def test_choices_are_all_ways_to_deal_the_types(spark):
    rng = random.Random(3)
    cases = [[(t, rng.randrange(4), rng.randrange(99), rng.random()) for t in kinds for _ in range(rng.randrange(1, 4))] for kinds in ([2, 6, 8], [6], [2, 8], [2, 6, 8])]
    cases = [sorted({(e[0], e[1]): e for e in case}.values()) for case in cases]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, o array<struct<cls:int,via:bigint,node:bigint,p:double>>")
    for r in rows.select("i", lb._choices([6, 2, 8]).alias("w")).collect():
        per = [[e for e in cases[r["i"]] if e[0] == t] for t in (2, 6, 8)]
        want = [list(s) for s in itertools.product(*[e for e in per if e]) if len({e[1] for e in s}) == len(s)]
        assert sorted([tuple(e) for e in s] for s in r["w"]) == sorted(want)


def test_coverage(spark, monkeypatch):
    rng, rows = random.Random(11), []
    for case in range(2):
        for t in range(5):
            at = [rng.uniform(0, 6) for _ in range(3)]
            for i in range(14):
                at = [a + rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for a in at]
                rows.append((case, t, i, *at, rng.choice([0.2, 0.5, 1.0, 1.5, 2.6, None, -1.0, 4.0 if case else 30.0])))
    p = spark.createDataFrame(rows, "case_id long, trace_id long, seq long, x double, y double, z double, rad double")
    a, b = _both(monkeypatch, lambda: ed._uncovered(p).select("case_id", "trace_id", "seq", "owner", "covered"))
    assert a == b and any("covered=True" in r or "'covered': True" in r for r in a)
    monkeypatch.setattr(casework, "CASE_ROWS", 1000)
    made, old = [], ed.stored
    monkeypatch.setattr(ed, "stored", lambda df, label="stage": made.append(label) or old(df, label))
    assert ed.remove_duplicate_coverage(p).count() and made == ["covered", "pieces"]


def test_surface_scores(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, x, y, z, float(rng.randint(0, 9)), int(rng.random() < 0.4), int(rng.random() < 0.4 and (x < 2 or c == 1))) for c in (1, 2, 3) for x in range(7) for y in range(6) for z in range(5) if c != 3 or x in (0, 6)]
    # Masks far apart, one empty, one without a box.
    rows = [(*r[:5], int(r[1] == 0 and r[5]), int(r[1] == 6)) if r[0] == 3 else r for r in rows] + [(4, 0, 0, 0, 1.0, 1, 0), (4, 3, 0, 0, 9.0, None, 1), (4, 1, 0, 0, None, None, 1), (5, 0, 0, 0, 1.0, 1, 0), (5, 2, 0, 0, 9.0, 0, 0)]
    v = spark.createDataFrame(rows, "case_id long, x long, y long, z long, intensity double, gt int, pred int")
    roi = spark.createDataFrame([(c, 1, 6, 0, 5, 0, 9) for c in (1, 2, 3, 4)], "case_id long, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")
    names = ["assd", "nf", "surface_score", "assd_roi", "nf_roi", "surface_score_roi"]
    a, b = _both(monkeypatch, lambda: ev.surface_score(v, (0.6, 0.3, 0.3), roi).select("case_id", *[F.round(c, 9).alias(c) for c in names]))
    assert a == b and len(a) == 5
    monkeypatch.setattr(casework, "CASE_ROWS", 1000)
    made = []
    monkeypatch.setattr(ev, "stored", lambda df, label="stage", old=ev.stored: made.append(label) or old(df, label))
    assert ev.surface_score(v, (0.6, 0.3, 0.3), roi).count() == 5 and made == ["voxels", "distance"]


def test_euler_numbers_of_small_masks_shuffle_runs_only(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, x, y, z) for c in (1, 2) for x in range(5) for y in range(5) for z in range(6) if rng.random() < 0.5]
    m = spark.createDataFrame(rows, "case_id long, x long, y long, z long")
    a, b = _both(monkeypatch, lambda: ev.betti(m))
    assert a == b
    plan = ev.run_euler(ev.runs(m).repartition("case_id"), ["case_id"])._jdf.queryExecution().executedPlan().toString()
    # One exchange for the distinct voxels, one for their lines at most, one for the masks; none behind the nine lines.
    assert "hashpartitioning(case_id" in plan and "X#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
