"""Position joins, graph loops and greedy rounds against plain loops."""

import itertools
import math
import random

import numpy as np
from conftest import SCHEMA, points, walk

from vesselspark.operators import editing as ed, evaluation as ev, graph as gr, matching as mt, tracking as tk, traces as tr
from vesselspark.plans import graphloop as gl, grid
from vesselspark.plans.rounds import first_free


def test_near_pairs_with_crowded_cells(spark):
    p = spark.createDataFrame(walk(5, 80) + walk(6, 80, trace_id=1), SCHEMA)
    q = mt.as_queries(p)
    rows = p.collect()
    want = {
        (a.trace_id, a.seq, b.trace_id, b.seq) for a in rows for b in rows
        if math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) < 2.5
    }
    for limit in (3, 100_000):
        got = {(r.q_trace_id, r.q_seq, r.trace_id, r.seq) for r in grid.near_pairs(q, p.drop("rad"), 2.5, mt.AT, cell_rows=limit).collect()}
        assert got == want


def test_components_forest_paths(spark):
    rng = random.Random(3)
    edges = [(c, a, b, rng.randint(1, 40) / 4) for c in (1, 2) for a, b in itertools.combinations(range(24), 2) if rng.random() < 0.07]
    df = spark.createDataFrame(edges, "case_id long, src long, dst long, w double")
    for case in (1, 2):
        parent = list(range(24))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        total = 0.0
        for c, a, b, w in sorted((e for e in edges if e[0] == case), key=lambda e: (e[3], e[1], e[2])):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                total += w
        got = gl.components(df.where(f"case_id = {case}")).collect()
        assert all(find(r.node) == find(r.comp) and r.comp <= r.node for r in got)
        assert len({r.comp for r in got}) == len({find(r.node) for r in got})
        assert gl.spanning_forest(df.where(f"case_id = {case}")).agg({"w": "sum"}).first()[0] == total
    dist = np.full((24, 24), np.inf)
    for c, a, b, w in edges:
        if c == 1:
            dist[a, b] = dist[b, a] = min(dist[a, b], w)
    np.fill_diagonal(dist, 0)
    for k in range(24):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
    one = df.where("case_id = 1")
    src = spark.createDataFrame([(1, 0), (1, 5)], "case_id long, source long")
    got = {(r.source, r.node): r.dist for r in gl.shortest_paths(one, src).collect()}
    assert got == {(s, n): dist[s, n] for s in (0, 5) for n in range(24) if np.isfinite(dist[s, n])}
    hops = {(r.source, r.node): r.hops for r in gl.fewest_hops(one, src).collect()}
    assert set(hops) == set(got)


def test_first_free_equals_the_walk(spark):
    rng = random.Random(1)
    pairs = [(a, b) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.12]
    kept = []
    for i in range(40):
        if not any((k, i) in set(pairs) for k in kept):
            kept.append(i)
    got = first_free(spark.range(40), spark.createDataFrame(pairs, "winner long, loser long"))
    assert sorted(r.id for r in got.collect()) == kept


def test_tracking_equals_a_sequential_replay(spark):
    vessels = [walk(20 + i, 30, trace_id=i) for i in range(4)]
    traced = [walk(20 + i, 30, trace_id=10 + i)[:20] for i in range(4)] + [walk(40, 25, trace_id=20)]
    v = spark.createDataFrame(sum(vessels, []), SCHEMA).withColumnRenamed("trace_id", "g")
    t = spark.createDataFrame(sum(traced, []), SCHEMA)
    linked, matched, tp, fn, ids, frag, dists = set(), set(), 0, 0, 0, 0, []
    for ves in vessels:
        cand = []
        for _, _, _, x, y, z, r in ves:
            best = {}
            for tr_ in traced:
                for _, tid, s, a, b, c, _ in tr_:
                    d = math.dist((x, y, z), (a, b, c))
                    if (tid, s) not in linked and d < r + 1 and (tid not in best or d < best[tid][1]):
                        best[tid] = (s, d)
            cand.append(best)
        matched |= {(p, m[0]) for c in cand for p, m in c.items()}
        given = [None if c else (-1, None) for c in cand]
        while None in given:
            votes = {}
            for c, a in zip(cand, given):
                if a is None:
                    for p in c:
                        votes[p] = votes.get(p, 0) + 1
            top = max(votes, key=lambda p: votes[p])
            for i, c in enumerate(cand):
                if top in c:
                    given[i] = (top, c[top][1])
                    linked.add((top, c[top][0]))
        names = [a[0] for a in given]
        tp += sum(n != -1 for n in names)
        fn += sum(n == -1 for n in names)
        dists += [a[1] for a in given if a[0] != -1]
        ids += sum(a != b for a, b in zip(names, names[1:]))
        frag += sum((a == -1) != (b == -1) for a, b in zip(names, names[1:]))
    r = tk.mot_metrics(v, t).first()
    n = sum(map(len, traced))
    assert (r.TP, r.FN, r.IDS, r.fragmentation, r.FP, r.IDFP) == (tp, fn, ids, frag, n - len(matched), n - len(linked))
    assert r.MOTP == __import__("pytest").approx(np.mean(dists))


def test_merge_at_ends(spark):
    p = points(spark, [[(0, 0, 0), (1, 0, 0)], [(3, 0, 0), (2, 0, 0), (1, 0, 0)], [(3, 0, 0), (4, 0, 0)], [(9, 9, 9), (9, 9, 8)]])
    rows = gr.merge_at_ends(p).orderBy("trace_id", "seq").collect()
    assert [r.x for r in rows if r.trace_id == 0] == [0, 1, 1, 2, 3, 3, 4]
    assert len(rows) == 9


def test_transfer_keeps_points(spark):
    p = points(spark, [[(x, 0, 0) for x in range(9)], [(3, y, 0) for y in range(6)]])
    out = ed.transfer(p, "length").orderBy("trace_id", "seq").collect()
    assert len(out) == 15
    assert [[r.seq for r in out if r.trace_id == t] for t in (0, 1)] == [list(range(sum(r.trace_id == t for r in out))) for t in (0, 1)]


def test_traces_from_graph(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 3, 5), (1, 10, 11), (1, 11, 12), (1, 10, 12)], "case_id long, src long, dst long")
    rows = gr.traces_from_graph(e).orderBy("chain", "seq").collect()
    chains = {}
    for r in rows:
        chains.setdefault(r.chain, []).append(r.node)
    got = sorted(tuple(c) if c[0] < c[-1] else tuple(reversed(c)) for c in chains.values())
    assert (0, 1, 2, 3) in got and (3, 4) in got and (3, 5) in got


def test_concatenated_length_never_grows_when_filtering(spark):
    p = spark.createDataFrame(walk(8, 60) + walk(9, 5, trace_id=1), SCHEMA)
    assert {r.trace_id for r in tr.remove_short(p, 5).select("trace_id").distinct().collect()} == {0}


def test_surface_distance_of_shifted_cubes(spark):
    cube = lambda side, dx: [(1, side, x + dx, y, z) for x in range(3) for y in range(3) for z in range(3)]
    m = spark.createDataFrame(cube(0, 0) + cube(1, 0), "case_id long, side int, x long, y long, z long")
    assert ev.surface_distance(m, (1, 1, 1)).first().assd == 0


def test_mutual_links_go_on_until_none_is_left(spark):
    from vesselspark.operators.graph import mutual_links

    # Each link is cheaper than the next one, so the links are settled one after the other.
    c = spark.createDataFrame([(1, f"{i:03d}", f"{i + 1:03d}", -10.0 + i / 100) for i in range(119)], "case_id long, a string, b string, loss double")
    assert mutual_links(c, 0.0).count() == 60


def test_only_kept_points_cover_others(spark):
    from vesselspark.operators.editing import remove_duplicate_coverage

    line = lambda x0, n, y, rad: [(x0 + i, y, float(i % 2), rad) for i in range(n)]
    # A covers all of B; C is touched by points of B only.
    p = points(spark, [line(0, 40, 10.0, 3.0), line(5, 12, 12.0, 2.0), line(5, 8, 14.0, 1.0)])
    kept = {r["trace_id"]: r["n"] for r in remove_duplicate_coverage(p).groupBy("trace_id").count().withColumnRenamed("count", "n").collect()}
    assert set(kept) == {0, 2} and kept[0] == 40


def test_positions_beyond_packed_ids_raise(spark):
    import pytest

    from vesselspark.operators.graph import with_nodes

    with pytest.raises(Exception, match="out of the range"):
        with_nodes(points(spark, [[(5000.0, 0, 0)]])).collect()


def test_links_go_past_near_traces_that_fail_the_gate(spark):
    from vesselspark.operators.compositions import greedy_links

    # The tail of 0 and the head of 2 face each other along bright voxels; 1 and 3 are nearer, in the dark.
    p = points(spark, [
        [(float(x), 0, 0) for x in range(-10, 1)], [(0, float(y), 0) for y in range(15, 26)],
        [(float(x), 0, 0) for x in range(20, 31)], [(20, float(-y), 0) for y in range(14, 25)],
    ])
    v = spark.createDataFrame([(1, x, 0, 0, 1.0) for x in range(31)], "case_id long, x long, y long, z long, score double")
    got = [(r["a"], r["b"]) for r in greedy_links(p, v).collect()]
    assert got in ([("0:1", "2:0")], [("2:0", "0:10")])
    # An inner point next to a head is not that trace's tail.
    near = points(spark, [[(float(x), 0, 0) for x in range(11)], [(1.0, float(y), 0) for y in range(5, 12)], [(float(x), 0, 0) for x in range(14, 21)]])
    bright = spark.createDataFrame([(1, x, y, 0, 1.0) for x in range(25) for y in range(12)], "case_id long, x long, y long, z long, score double")
    assert {("0:1", "2:0"), ("2:0", "0:10")} & {(r["a"], r["b"]) for r in greedy_links(near, bright).collect()}
