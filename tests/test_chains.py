"""List ranking, chains of voxels and merged traces against plain walks."""

import itertools
import random

import pytest
from conftest import SCHEMA, points

from vesselspark.operators import graph as gr
from vesselspark.plans import graphloop as gl


def test_long_chains_take_a_round_for_each_doubling(spark, monkeypatch):
    tables = []
    kept = gl.stored
    monkeypatch.setattr(gl, "stored", lambda df, label="stage": tables.append(label) or kept(df, label))
    n = 4096
    names = list(range(n))
    random.Random(1).shuffle(names)
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(names, names[1:])], "case_id long, src long, dst long")
    got = gl.chain_ranks(edges, spark.createDataFrame([(1, names[0])], "case_id long, source long"))
    assert {r["node"]: r["hops"] for r in got.collect()} == {v: i for i, v in enumerate(names)}
    assert tables.count("ranks") - 1 <= 13


def test_ranks_of_lists_of_all_lengths(spark):
    rng = random.Random(2)
    rows, want, at = [], {}, 0
    for case, n in itertools.product((1, 2), [1, 2, 3, 4, 5, 8, 9, 33, 100]):
        ids = list(range(at, at + n))
        at += n
        rng.shuffle(ids)
        rows += [(case, a, b) for a, b in zip(ids, [*ids[1:], None])]
        want |= {(case, a): (ids[-1], n - 1 - i) for i, a in enumerate(ids)}
    got = gl.list_ranks(spark.createDataFrame(rows, "case_id long, at long, next long")).collect()
    assert {(r["case_id"], r["at"]): (r["last"], r["steps"]) for r in got} == want


def test_rings_and_junctions_become_chains(spark):
    ring = [(1, a, b) for a, b in zip([50, 7, 91, 30, 12], [7, 91, 30, 12, 50])]
    loop = [(1, 200, 201), (1, 201, 202), (1, 202, 200), (1, 200, 210), (1, 200, 211)]  # 201 and 202 leave 200 and come back to it
    single = [(1, 300, 301), (1, 301, 302), (1, 302, 303), (1, 302, 304)]
    e = spark.createDataFrame([(c, min(a, b), max(a, b)) for c, a, b in ring + loop + single], "case_id long, src long, dst long")
    chains = {}
    for r in gr.traces_from_graph(e).orderBy("chain", "seq").collect():
        chains.setdefault(r["chain"], []).append((r["seq"], r["node"]))
    assert all([s for s, _ in c] == list(range(len(c))) for c in chains.values())
    got = sorted([n for _, n in c] for c in chains.values())
    assert [7, 50, 12, 30, 91] in got
    assert [200, 201, 202, 200] in got and [200, 210] in got and [200, 211] in got
    assert [300, 301, 302] in got and [302, 303] in got and [302, 304] in got and len(got) == 7


def plain_merge(traces):
    """Chains walked link by link; ends meet where exactly two ends of different traces share a position."""
    spots = {}
    for t, pts in traces.items():
        for e, p in ((0, pts[0]), (1, pts[-1])):
            spots.setdefault(p, []).append((t, e))
    partner = {}
    for ends in spots.values():
        if len(ends) == 2 and ends[0][0] != ends[1][0]:
            partner[ends[0]], partner[ends[1]] = ends[1], ends[0]
    out, done = {}, set()

    def walk(t, e):
        seen, way = set(), []
        while t not in seen:
            seen.add(t)
            way.append(traces[t][::-1] if e else traces[t])
            if (t, 1 - e) not in partner:
                break
            t, e = partner[t, 1 - e]
        done.update(seen)
        out[min(seen)] = sum(way, [])

    free = lambda t: [e for e in (0, 1) if (t, e) not in partner]
    for t in sorted(traces):
        if t not in done and free(t):
            walk(t, 1 if free(t) == [1] else 0)
    for t in sorted(traces):
        if t not in done:
            walk(t, 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_traces_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    traces = {}
    for t in range(60):  # ends fall on few spots: paths, rings of two and more, spots met by three
        a, b = (float(rng.randrange(1000 * seed, 1000 * seed + 70)) for _ in range(2))
        traces[t] = [(a, 0.0, 0.0), *[(a, float(t + 1), float(i + 1)) for i in range(rng.randint(0, 3))], (b, 0.0, 0.0)]
    traces |= {100: [(5.0, 5.0, 0.0), (6.0, 5.0, 0.0)], 101: [(5.0, 5.0, 0.0), (7.0, 5.0, 0.0), (6.0, 5.0, 0.0)]}
    rows = [(1, t, i, *p, 1.0) for t, pts in traces.items() for i, p in enumerate(pts)]
    got = {}
    for r in gr.merge_at_ends(spark.createDataFrame(rows, SCHEMA)).orderBy("trace_id", "seq").collect():
        got.setdefault(r["trace_id"], []).append((r["seq"], (r["x"], r["y"], r["z"])))
    assert all([s for s, _ in g] == list(range(len(g))) for g in got.values())
    assert {t: [p for _, p in g] for t, g in got.items()} == plain_merge(traces)


def test_nothing_to_merge(spark):
    p = points(spark, [[(0, 0, 0), (1, 0, 0)], [(5, 0, 0), (6, 0, 0)]])
    assert gr.merge_at_ends(p).count() == 4 and gr.merge_at_ends(p.limit(0)).count() == 0
