"""Paths to goals and arteries between two targets, against Dijkstra."""

import heapq
import math
import random

from conftest import SCHEMA

from vesselspark.operators.arteries import select_artery
from vesselspark.plans import graphloop as gl

TARGETS = "case_id long, which int, qx double, qy double, qz double"


def dijkstra(edges, source):
    near, done, queue = {}, {}, [(0.0, source)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while queue:
        d, n = heapq.heappop(queue)
        if n not in done:
            done[n] = d
            for m, w in near.get(n, []):
                heapq.heappush(queue, (d + w, m))
    return done


def test_paths_to_goals(spark):
    rng = random.Random(1)
    edges = []
    for case in (1, 2):
        for a in range(60):
            for b in rng.sample(range(60), 2):
                edges.append((case, a, b, float(rng.randint(1, 30))))
        edges += [(case, 100, 101, 1.0)] + [(case, 200 + i, 201 + i, 0.25) for i in range(8)]
    pairs = [(c, i, rng.randrange(60), rng.randrange(60)) for c in (1, 2) for i in range(4)] + [(1, 7, 0, 100), (1, 8, 5, 5), (2, 9, 200, 208)]
    frame = spark.createDataFrame(edges, "case_id long, src long, dst long, w double")
    ask = spark.createDataFrame(pairs, "case_id long, pair long, source long, goal long")
    for width in (None, 1e9):
        got = {}
        for r in gl.paths_to_goals(frame, ask, width=width).orderBy("place").collect():
            got.setdefault((r["case_id"], r["pair"]), []).append(r)
        for case, pair, source, goal in pairs:
            mine = [(a, b, w) for c, a, b, w in edges if c == case]
            want = dijkstra(mine, source).get(goal)
            way = got.get((case, pair))
            if want is None:
                assert way is None
                continue
            assert [r["place"] for r in way] == list(range(len(way))) and way[-1]["dist"] == want
            assert (way[0]["node"], way[-1]["node"]) == (source, goal)
            least = {}
            for a, b, w in mine:
                least[a, b] = least[b, a] = min(w, least.get((a, b), w))
            for u, v in zip(way, way[1:]):
                assert v["dist"] == u["dist"] + least[u["node"], v["node"]]


def line(start, step, n):
    return [tuple(s + d * i for s, d in zip(start, step)) for i in range(n)]


def test_arteries_of_all_kinds(spark):
    cases = {
        # Two pieces 26 apart: links need the longer reach, and the head lies before the first piece.
        1: ([line((0, 0, 0), (1, 0, 0), 10), line((35, 0, 0), (1, 0, 0), 6), line((0, 300, 0), (1, 0, 0), 5)], [(0, -5.0, 0.0, 0.0), (1, 45.0, 0.0, 0.0)]),
        # Both on one trace, given from back to front; the end's nearest point is inside the trace.
        2: ([line((0, 0, 0), (1, 0, 0), 40)], [(0, 35.0, 1.0, 0.0), (1, 4.0, 1.0, 0.0)]),
        # A trunk with a side branch: the way leaves the trunk at the junction.
        3: ([line((0, 0, 0), (1, 0, 0), 30), line((12, 0, 0), (0, 1, 0), 25)], [(0, 0.0, 0.0, 0.0), (1, 12.0, 24.0, 0.0)]),
        # The head is out of reach, the point inside is met; from there the way goes on to the trace's start.
        4: ([line((0, 0, 0), (1, 0, 0), 30), line((29, 1, 0), (0, 1, 0), 20)], [(0, -30.0, 0.0, 0.0), (3, 10.0, 2.0, 0.0), (1, 29.0, 20.0, 0.0)]),
        # The end lies on a piece that no reach connects.
        5: ([line((0, 0, 0), (1, 0, 0), 10), line((500, 0, 0), (1, 0, 0), 10)], [(0, 0.0, 0.0, 0.0), (1, 505.0, 0.0, 0.0)]),
        # The end is far from everything.
        6: ([line((0, 0, 0), (1, 0, 0), 10)], [(0, 0.0, 0.0, 0.0), (1, 900.0, 0.0, 0.0)]),
    }
    rows = [(c, t, i, *map(float, p), 1.0 + t) for c, (traces, _) in cases.items() for t, pts in enumerate(traces) for i, p in enumerate(pts)]
    asked = [(c, *t) for c, (_, ts) in cases.items() for t in ts]
    got = {}
    for r in select_artery(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, TARGETS), gaps=(10.0, 30.0)).orderBy("case_id", "seq").collect():
        got.setdefault(r["case_id"], []).append((r["seq"], (r["x"], r["y"], r["z"])))
    assert all([s for s, _ in g] == list(range(len(g))) for g in got.values())
    way = {c: [p for _, p in g] for c, g in got.items()}
    x = lambda *v: [(float(i), 0.0, 0.0) for i in v]
    assert way[1] == x(-5, *range(10), *range(35, 41), 45)
    assert way[2] == x(*range(35, 4, -1))
    assert way[3] == x(0, *range(13)) + [(12.0, float(i), 0.0) for i in range(1, 25)] + [(12.0, 24.0, 0.0)]
    assert way[4] == x(-30, *range(30)) + [(29.0, float(i), 0.0) for i in range(1, 21)] + [(29.0, 20.0, 0.0)]
    assert set(way) == {1, 2, 3, 4}
    assert math.isclose(sum(math.dist(a, b) for a, b in zip(way[3], way[3][1:])), 36.0)


def test_an_end_that_also_lies_on_the_first_trace_is_reached_by_the_shortest_path(spark):
    """The query's SQL knows no rule for two targets on one trace, and a position may lie on several."""
    from vesselspark.catalog.graphs import select_artery as query

    bend = line((0, 0, 0), (1, 0, 0), 10) + line((9, 1, 0), (0, 1, 0), 2) + line((9, 3, 0), (-1, 0, 0), 10)
    rows = [(1, t, i, *map(float, p), 1.0) for t, pts in enumerate([bend, line((0, 8, 0), (0, -1, 0), 6)]) for i, p in enumerate(pts)]
    (row,) = query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row["length"] == 3.0
