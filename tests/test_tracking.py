"""Matching of vessels to traces, against the walk over the vessels in their order."""

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from vesselspark.operators import tracking as tk
from vesselspark.plans import casework
from vesselspark.plans.grid import within
from vesselspark.session import shared_folder


def walk_over(vessels, traced):
    """The assignment one vessel after the other."""
    out, linked = {}, set()
    for g in sorted({v[1] for v in vessels}):
        near = {}
        for _, _, s, x, y, z, rad in (v for v in vessels if v[1] == g):
            for _, p, ps, *at in traced:
                d = math.dist((x, y, z), at)
                if d < rad + 1 and (p, ps) not in linked:
                    near.setdefault(s, {})[p] = min(near.get(s, {}).get(p, (9e9, 0)), (d, ps))
        open_ = dict(near)
        while open_:
            votes = {}
            for s, ps in open_.items():
                for p in ps:
                    n, first = votes.get(p, (0, s))
                    votes[p] = (n - 1, min(first, s))
            best = min((n, first, p) for p, (n, first) in votes.items())[2]
            for s, ps in near.items():
                if best in ps:
                    out[g, s] = best
                    linked.add((best, ps[best][1]))
            open_ = {s: ps for s, ps in open_.items() if best not in ps}
    return out, linked


def test_vessels_that_wait_for_each_other_write_their_candidates_once(spark):
    rng = random.Random(4)
    spot = lambda: (rng.randint(0, 8) + 0.01 * rng.randint(0, 99), rng.randint(0, 3) + 0.01 * rng.randint(0, 99), 0.0)
    vessels = [(1, g, s, *spot(), 0.5) for g in range(5) for s in range(8)]
    traced = [(1, p, s, *spot()) for p in range(6) for s in range(6)]
    want, linked = walk_over(vessels, traced)
    v = spark.createDataFrame(vessels, "case_id long, g long, seq long, x double, y double, z double, rad double")
    t = spark.createDataFrame(traced, "case_id long, trace_id long, seq long, x double, y double, z double")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    a, _, lk = tk.assign_traces(v, t)
    assert {(r["g"], r["gseq"]): r["p"] for r in a.collect()} == want
    assert {(r["p"], r["pseq"]) for r in lk.collect()} == linked
    left = [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before]
    assert not {"candidates", "ready", "best", "pairs"} & set(left), left
    far = tk.assign_traces(v.withColumn("x", F.col("x") + 100), t)
    assert [df.count() for df in far] == [0, 0, 0]


def test_cases_in_tasks_equal_rounds(spark, monkeypatch):
    rng = random.Random(9)
    spot = lambda: (rng.randint(0, 9) + rng.choice([0.0, 0.5]), rng.randint(0, 4) / 2, rng.choice([0.0, -3.0]))
    vessels = [(c, g, s, *spot(), rng.choice([0.5, 1.5, 0.1, -1.0, None])) for c in (1, 2) for g in range(4) for s in range(9)]
    traced = [(c, p, s, *spot()) for c in (1, 3) for p in range(5) for s in range(8)]
    traced += [(2, p, s, *spot()) for p in range(3) for s in (0, 1, 1, 2)]
    v = spark.createDataFrame(vessels, "case_id long, g long, seq long, x double, y double, z double, rad double")
    t = spark.createDataFrame(traced, "case_id long, trace_id long, seq long, x double, y double, z double")
    got = []
    for rows in (casework.CASE_ROWS, 0):
        monkeypatch.setattr(casework, "CASE_ROWS", rows)
        got.append([sorted(map(tuple, df.collect())) for df in tk.assign_traces(v, t)])
    assert got[0] == got[1] and all(got[0])
    monkeypatch.undo()
    made = []
    monkeypatch.setattr(tk, "stored", lambda df, label="stage", old=tk.stored: made.append(label) or old(df, label))
    assert tk.mot_metrics(v, t).count() == 2 and made == ["vessels", "matches"]


def test_search_in_memory_equals_all_pairs():
    rng = np.random.default_rng(3)
    t, q = rng.integers(-6, 6, (300, 3)) / 2, rng.integers(-6, 6, (80, 3)) / 2
    r = rng.choice([0.0, -1.0, 0.5, 1.0, 1.5, 4.0, 900.0, np.nan], 80)
    want = {(i, j) for i in range(80) for j in range(300) if math.dist(q[i], t[j]) < r[i]}
    got = [(int(i), int(j)) for a in within(t)(q, r) for i, j, _ in zip(*a)]
    assert set(got) == want and len(got) == len(want)
