"""Loop cutting and rooted forests."""

import math
import random

from conftest import SCHEMA, points

from vesselspark.operators import graph as gr
from vesselspark.operators.compositions import main_tree_without_loops
from vesselspark.plans import graphloop as gl


def loops_left(rows):
    """Edges, nodes and components of traces given as rows."""
    traces, edges, parent = {}, set(), {}
    for r in sorted(rows, key=lambda r: (r["case_id"], r["trace_id"], r["seq"])):
        traces.setdefault((r["case_id"], r["trace_id"]), []).append((r["case_id"], r["x"], r["y"], r["z"]))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for t in traces.values():
        for p in t:
            parent.setdefault(p, p)
        for a, b in zip(t, t[1:]):
            if a != b:
                edges.add((min(a, b), max(a, b)))
    for a, b in edges:
        parent[find(a)] = find(b)
    return len(edges), len(parent), len({find(p) for p in parent})


def test_a_ring_is_cut_at_its_longest_step(spark):
    ring = [(10 * math.cos(a / 10), 10 * math.sin(a / 10), 0.0) for a in range(62)]
    far = [(100.0 + i, 0.0, 0.0) for i in range(5)]
    # A trace whose ends lie 3 beside the ring and 3 beyond the other trace's head.
    bridge = [(13.0 + i, 0.0, 0.0) for i in range(85)]
    p = points(spark, [ring + [ring[0]], far, bridge])
    out = gr.without_loops(p, 5.0).collect()
    edges, nodes, trees = loops_left(out)
    assert (edges, nodes, trees) == (62 + 5 + 85 - 1, 62 + 5 + 85, 1)
    traces = {}
    for r in out:
        traces.setdefault(r["trace_id"], set()).add(r["from_trace"])
    assert sorted(min(f) for f in traces.values()) == [0, 1, 2] or sorted(min(f) for f in traces.values()) == [0, 0, 1, 2]
    assert all(len(f) == 1 for f in traces.values())
    seqs = {}
    for r in out:
        seqs.setdefault(r["trace_id"], []).append(r["seq"])
    assert all(sorted(s) == list(range(len(s))) for s in seqs.values())


def test_no_loop_is_left_in_tangles(spark):
    rng = random.Random(3)
    rows = []
    for case in (1, 2):
        for t in range(8):
            x, y = rng.randrange(6), rng.randrange(6)
            for i in range(rng.choice([1, 2, 14])):
                rows.append((case, t, i, float(x), float(y), 0.0, 1.0 + t))
                x, y = x + rng.choice([-1, 0, 1]), y + rng.choice([-1, 0, 1])
    frame = spark.createDataFrame(rows, SCHEMA)
    out = gr.without_loops(frame, 1.5).collect()
    edges, nodes, trees = loops_left(out)
    assert edges == nodes - trees
    assert {(r["case_id"], r["x"], r["y"]) for r in out} == {(r[0], r[3], r[4]) for r in rows}
    assert gr.without_loops(frame.limit(0), 1.5).count() == 0


def test_parents_lead_to_the_root(spark):
    rng = random.Random(4)
    edges, roots, up = [], [], {}
    for case in (1, 2, 3):
        names = list(range(60))
        rng.shuffle(names)
        for i, v in enumerate(names):
            u = names[rng.randrange(max(0, i - 4), i)] if i % 20 else None  # three trees of 20 nodes
            up[case, v] = u
            if u is None:
                roots.append((case, v))
            else:
                edges.append((case, min(u, v), max(u, v)))
    got = gl.rooted(spark.createDataFrame(edges, "case_id long, src long, dst long"), spark.createDataFrame(roots, "case_id long, node long"))
    assert {(r["case_id"], r["node"]): r["parent"] for r in got.collect()} == up


def test_main_tree_has_one_parent_for_each_position(spark):
    trunk = [(float(i), 0.0, 0.0) for i in range(30)]
    loop = [(10.0, float(i), 0.0) for i in range(8)] + [(10.0 + i, 7.0, 0.0) for i in range(1, 9)] + [(18.0, 7.0 - i, 0.0) for i in range(1, 8)]
    side = [(25.0, float(-i), 0.0) for i in range(9)]
    # Their tails lie in one cell but not at one position: joining them would close a loop over the trunk.
    legs = [[(x, float(y), 0.0) for y in range(20, 41)] for x in (3.0, 5.0)]
    legs = [[(3.0, 0.0, 0.0), *legs[0], (4.2, 41.0, 0.0)], [(5.0, 0.0, 0.0), *legs[1], (4.8, 41.0, 0.0)]]
    p = points(spark, [trunk, loop, side, *legs])
    out = main_tree_without_loops(p, 3.0, 1, 0.5).collect()
    edges, nodes, trees = loops_left(out)
    assert trees == 1 and edges == nodes - 1
    parents = {}
    for r in out:
        assert parents.setdefault(r["node"], r["parent"]) == r["parent"]
    assert sum(v is None for v in parents.values()) == 1 and len(parents) == nodes
    for n in parents:
        seen = set()
        while n is not None:
            assert n not in seen
            seen.add(n)
            n = parents[n]
