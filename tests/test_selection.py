"""Choice of traces by clustering and growth, against plain loops."""

import math
import random

from conftest import SCHEMA

from vesselspark.operators import selection
from vesselspark.operators.matching import AT, as_queries
from vesselspark.operators.selection import cluster_centres, grown, select_traces
from vesselspark.plans import casework
from vesselspark.plans.grid import near_groups


def line(x, n, step=1.0):
    return [(float(x), float(i % 3), float(i * step)) for i in range(n)]


def rows_of(case, traces, shift=0.0):
    return [(case, t, i, x + shift, y, z, 1.0) for t, pts in enumerate(traces) for i, (x, y, z) in enumerate(pts)]


def plain_labels(traces, centres, most):
    """Labels of one case by nested loops."""
    if len(traces) < 3:
        return [0] * len(traces)
    chosen, close = [], set()
    mean = [(sum(p[0] for p in t) / len(t), sum(p[1] for p in t) / len(t)) for t in traces]
    for c in centres:
        best = min(((min(math.dist(p, c) for p in t) / len(t), i) for i, t in enumerate(traces) if i not in chosen and i not in close), default=(math.inf, None))
        chosen.append(best[1] if best[0] < most else None)
        if chosen[-1] is not None:
            m = chosen[-1]
            close |= {i for i, t in enumerate(traces) if i != m and (min(math.dist(p, q) for p in t for q in traces[m]) < most or math.dist(mean[i], mean[m]) < most)}
    if chosen.count(None) > 1:
        return [None] * len(traces)
    chosen = [c for c in chosen if c is not None]
    reached, queue = set(chosen), list(chosen)
    while queue:
        m = queue.pop()
        for i, t in enumerate(traces):
            if i not in reached and any(math.dist(p, q) < most for p in [*t[::5], t[-1]] for q in traces[m]):
                reached.add(i)
                queue.append(i)
    return [0 if i in chosen else 1 if i in reached else -1 for i in range(len(traces))]


def test_labels_equal_the_loop(spark):
    rng = random.Random(2)
    cases = {
        1: [line(0, 40), line(30, 8), line(200, 50), line(212, 6), line(600, 5), line(20, 9), line(44, 7), line(68, 5)],
        2: [line(0, 5), line(99, 5)],
        # Its points come near only between two samples, and a trace that is reached through others.
        3: [line(0, 60), [(30.0 - abs(i - 2) * 3 + 0.5, 90.0, 5.0) for i in range(5)], line(24, 6), line(48, 6), line(72, 6), line(400, 40)],
    }
    for c in range(4, 9):
        cases[c] = [[(rng.uniform(0, 150), rng.uniform(0, 150), rng.uniform(0, 20)) for _ in range(1)] for _ in range(25)]
        for t in cases[c]:
            for _ in range(rng.randint(0, 14)):
                t.append(tuple(v + rng.uniform(-6, 6) for v in t[-1]))
    frame = spark.createDataFrame(sum((rows_of(c, t, 1000.0 * c) for c, t in cases.items()), []), SCHEMA)
    got = {}
    for r in select_traces(frame, k=2, most=25.0).collect():
        got.setdefault(r["case_id"], {})[r["trace_id"]] = r["label"]
    big = [c for c in cases if len(cases[c]) > 2]
    centres = {}
    for r in cluster_centres(frame.where(frame.case_id.isin(big)), 2).orderBy("case_id", "cluster").collect():
        centres.setdefault(r["case_id"], []).append((r["kx"] - 1000.0 * r["case_id"], r["ky"], r["kz"]))
    for c, traces in cases.items():
        assert [got[c][i] for i in range(len(traces))] == plain_labels(traces, centres.get(c), 25.0), c
    assert {v for g in got.values() for v in g.values()} == {-1, 0, 1}


def test_selection_without_centres_fails_and_ranges_bind(spark):
    far = [(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (1e4, 0.0, 0.0), (1e4 + 10, 0.0, 0.0)]
    frame = spark.createDataFrame(rows_of(1, [[p] for p in far]), SCHEMA)
    assert [r["label"] for r in select_traces(frame, k=2, most=1.0).collect()] == [None] * 4
    low = spark.createDataFrame(rows_of(1, [line(0, 30), line(100, 30), [(50.0, 0.0, 500.0 + i) for i in range(30)]]), SCHEMA)
    picked = {r["trace_id"]: r["label"] for r in select_traces(low, k=2, high=100.0).collect()}
    assert picked == {0: 0, 1: 0, 2: -1}
    assert select_traces(low.limit(0)).count() == 0


def test_growth_takes_a_round_for_each_step(spark):
    frame = spark.createDataFrame(rows_of(1, [line(10 * i, 6) for i in range(12)] + [line(400, 6)]), SCHEMA)
    start = spark.createDataFrame([(1, 3)], "case_id long, trace_id long")
    got = {r["trace_id"]: r["round"] for r in grown(frame, start, 10.5).collect()}
    assert got == {i: abs(i - 3) for i in range(12)}


def test_groups_near_targets_equal_all_pairs(spark):
    rng = random.Random(9)
    a = [(1, rng.randint(0, 60), i, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-3, 3), 1.0) for i in range(400)]
    b = [(1, 100, i, rng.choice([-20.0, 0.0, 3.5, 20.0]), rng.choice([-20.0, 1.0]), 0.0, 1.0) for i in range(300)]
    for r in (0.7, 3.0, 11.0):
        want = {p[1] for p in a for q in b if math.dist(p[3:6], q[3:6]) < r}
        near = near_groups(as_queries(spark.createDataFrame(a, SCHEMA)), spark.createDataFrame(b, SCHEMA), r, AT, ["case_id", "q_trace_id"])
        assert {x["q_trace_id"] for x in near.collect()} == want and near.count() == len(want)


def test_cases_in_tasks_equal_rounds(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for c in range(1, 7):
        traces = [[tuple(rng.randint(0, 60 if c < 5 else 600) / 2 for _ in range(3))] for _ in range(8)]
        for t in traces:
            for _ in range(rng.randint(0, 13)):
                t.append(tuple(v + rng.choice([-2.0, 0.0, 0.5, 2.0]) for v in t[-1]))
        rows += rows_of(c, traces)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = []
    for most in (casework.CASE_ROWS, 0):
        monkeypatch.setattr(casework, "CASE_ROWS", most)
        got.append([sorted(map(repr, select_traces(frame, k=3, most=6.0, low=2.0).collect()))])
    assert got[0] == got[1]
    monkeypatch.undo()
    made = []
    monkeypatch.setattr(selection, "stored", lambda df, label="stage", old=selection.stored: made.append(label) or old(df, label))
    assert select_traces(frame).count() == 48 and made == ["traces", "points"]
