"""One artery of each case, as a trace between two positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as g
from ..plans.blocks import BLOCK, running
from ..plans.graphloop import components, paths_to_goals
from ..plans.grid import nearest
from ..session import stored
from .graph import node_graph, simple_degree, with_nodes
from .matching import AT, as_queries, ends, nearest_per_trace
from .traces import KEYS, POS, with_step

HEAD, END, NEAR_END, NEAR_HEAD = 0, 1, 2, 3


def contracted(points: DataFrame, stops: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Runs of traces between junctions, ends and ``stops(case_id, node)``.

    Returns the points with ``seg`` (the run a point ends or lies in), ``stop`` and ``node``, and the
    runs as edges (case_id, src, dst, w, trace_id, seg, s0, s1, forward); of runs between the same two nodes the
    shortest.
    """
    p = with_nodes(with_step(points, size).drop("p1_x", "p1_y", "p1_z", "p1_rad"))
    deg = simple_degree(node_graph(points, size)[1])
    tips = with_nodes(ends(points).select(*KEYS, *POS)).select("case_id", "node")
    every = deg.where("deg <> 2").select("case_id", "node").unionByName(tips).unionByName(stops.select("case_id", "node")).distinct()
    p = p.join(every.withColumn("stop", F.lit(True)), ["case_id", "node"], "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    # Run k holds the points after stop k up to stop k + 1; the head of a trace is stop 1.
    p = running(p, KEYS, "seq", {"_c": F.col("stop").cast("bigint")}, size=size)
    p = stored(p.withColumn("seg", F.col("_c") - F.col("stop").cast("bigint")).drop("_c"), "runs")
    body = p.where("seg > 0").groupBy(*KEYS, "seg").agg(
        F.sum("step").alias("w"), F.max("seq").alias("s1"), F.count("*").alias("_n"), F.max(F.when(F.col("stop"), F.col("node"))).alias("b")
    )
    start = p.where("stop").select(*KEYS, (F.col("seg") + 1).alias("seg"), F.col("node").alias("a"))
    run = body.join(start, [*KEYS, "seg"]).where("a <> b").withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
    best = run.groupBy("case_id", "src", "dst").agg(F.min(F.struct("w", "trace_id", "seg", (F.col("s1") - F.col("_n")).alias("s0"), "s1", (F.col("a") < F.col("b")).alias("forward"))).alias("m"))
    return p, stored(best.select("case_id", "src", "dst", "m.*"), "run-edges")


def matched_targets(points: DataFrame, targets: DataFrame, near: float, inner: float, most: float, step: float) -> DataFrame:
    """The point that each side starts from: (case_id, side, inner, trace_id, seq, node).

    The outer target's nearest point within ``near``; else, with a reach that grows from ``inner`` by
    ``step`` to ``most``, the nearest point of the inner target (``inner`` is true) or of the outer one,
    whichever is met first, the inner one if both are.
    """
    at = points.select(*KEYS, "seq", *POS)
    q = targets.select("case_id", "which", *AT)
    first = stored(nearest(q.where(F.col("which") < 2), at, near, AT, ["case_id", "which"], ["trace_id", "seq"]), "targets")
    done = first.select("case_id", F.col("which").alias("side"), F.lit(False).alias("inner"), "trace_id", "seq")
    side = F.when(F.col("which").isin(HEAD, NEAR_HEAD), HEAD).otherwise(END)
    rest = stored(q.withColumn("side", side).join(done.select("case_id", "side"), ["case_id", "side"], "left_anti"), "open")
    found = None
    r = inner
    while not rest.isEmpty():  # doubled reaches; the schedule's step is worked out from the distance
        r = min(r, most)
        hit = stored(nearest(rest, at, r, AT, ["case_id", "side", "which"], ["trace_id", "seq"]), "targets")
        found = hit if found is None else found.unionByName(hit)
        rest = stored(rest.join(hit, ["case_id", "side", "which"], "left_anti"), "open")
        if r >= most:
            break
        r *= 2
    if found is not None:
        turn = F.greatest(F.floor((F.col("dist") - inner) / step) + 1, F.lit(0))
        best = found.groupBy("case_id", "side").agg(F.min(F.struct(turn.alias("turn"), (-F.col("which")).alias("k"), "trace_id", "seq")).alias("m"))
        done = done.unionByName(best.select("case_id", "side", (F.col("m.k") <= -2).alias("inner"), "m.trace_id", "m.seq"))
    nodes = with_nodes(points).select(*KEYS, "seq", "node")
    return stored(done.join(nodes, [*KEYS, "seq"]), "matched")


def select_artery(
    points: DataFrame, targets: DataFrame, near: float = 12.0, inner: float = 8.0, most: float = 101.0, step: float = 3.0,
    gaps: Sequence[float] = tuple(float(v) for v in range(10, 101, 10)), detour: float = 1.5, same_trace: bool = True,
) -> DataFrame:
    """The artery between two targets of a case as a trace: (case_id, seq, x, y, z, rad).

    ``targets(case_id, which, qx, qy, qz)``: 0 the head, 1 the end; 2 and 3, which may be missing, lie inside
    the artery near the end and near the head.  Targets are matched to points (``matched_targets``); if both
    are on one trace, that trace is taken (unless ``same_trace`` is false).  Else the shortest path over the traces and over
    links from each trace end to the nearest point of every other trace is taken, with the least reach of ``gaps`` that
    connects the two.  From an inner target the path goes on to the outer one if that takes less than
    ``detour`` times the straight way.  The trace is trimmed to the points nearest to the head
    and to the end; a target whose nearest point is the trace's last is put after it.  Cases without a path have no rows.
    """
    base = [*KEYS, "seq", *POS, "rad"]
    p = stored(points.select(*base), "points")
    side = matched_targets(p, targets, near, inner, most, step)
    pick = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}{k}")
    both = stored(side.groupBy("case_id").agg(*[pick(k, c) for k in (0, 1) for c in ("node", "trace_id", "inner")]).where("node0 is not null and node1 is not null"), "sides")
    alone = both.where(F.lit(same_trace) & F.expr("trace_id0 = trace_id1 and not inner0 and not inner1")).select("case_id", F.col("trace_id0").alias("trace_id"))
    whole = p.join(alone, KEYS).select("case_id", "seq", *POS, "rad")
    search = both.join(alone, "case_id", "left_anti")
    # Legs: 1 between the matched points, 0 and 2 from an inner match to the outer target.
    legs = search.select("case_id", F.lit(1).alias("pair"), F.col("node0").alias("source"), F.col("node1").alias("goal"))
    outer = targets.join(search.select("case_id", "inner0", "inner1"), "case_id").where("(which = 0 and inner0) or (which = 1 and inner1)")
    outer = stored(outer.select("case_id", "which", *AT), "outer")
    goal = nearest(outer, with_nodes(p), 50.0, AT, ["case_id", "which"], ["trace_id", "seq"], keep=["node"])
    start = search.select("case_id", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("node0").alias("source")), F.struct(F.lit(1).alias("which"), F.col("node1").alias("source")))).alias("s")).select("case_id", "s.*")
    more = goal.join(start, ["case_id", "which"]).select("case_id", (F.col("which") * 2).alias("pair"), "source", F.col("node").alias("goal"))
    legs = stored(legs.unionByName(more), "legs")
    nodes = with_nodes(p).groupBy("case_id", "node").agg(*[F.first(c).alias(c) for c in POS], F.max_by("rad", F.struct("trace_id", "seq")).alias("rad"))
    nodes = stored(nodes, "nodes")
    comp = stored(components(node_graph(p)[1], nodes.select("case_id", "node")), "pieces")
    tips = stored(as_queries(ends(p)).dropDuplicates(["case_id", "q_trace_id", "q_seq"]), "tips")
    paths, waiting = None, legs
    for gap in gaps:
        mine = waiting.select("case_id").distinct()
        here = p.join(mine, "case_id", "left_semi")
        hit = nearest_per_trace(tips.join(mine, "case_id", "left_semi"), here, gap).join(tips, ["case_id", "q_trace_id", "q_seq"])
        hit = hit.join(with_nodes(here).select(*KEYS, "seq", "node"), [*KEYS, "seq"])
        link = hit.select("case_id", with_nodes_at().alias("a"), F.col("node").alias("b"), F.col("dist").alias("w")).where("a <> b")
        link = stored(link.select("case_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w").distinct(), "links")
        named = lambda df, c: df.join(comp.select("case_id", F.col("node").alias(c), F.col("comp").alias(f"{c}_piece")), ["case_id", c])
        joins = named(named(link, "src"), "dst").select("case_id", F.col("src_piece").alias("src"), F.col("dst_piece").alias("dst")).where("src <> dst").distinct()
        joined = stored(components(joins, comp.select("case_id", F.col("comp").alias("node")).distinct()), "joined")
        root = comp.withColumnRenamed("comp", "piece").join(joined.select("case_id", F.col("node").alias("piece"), "comp"), ["case_id", "piece"])
        ends_ = waiting.join(root.select("case_id", F.col("node").alias("source"), F.col("comp").alias("c0")), ["case_id", "source"]).join(
            root.select("case_id", F.col("node").alias("goal"), F.col("comp").alias("c1")), ["case_id", "goal"])
        ready = stored(ends_.where("c0 = c1").select("case_id", "pair", "source", "goal"), "ready")
        if not ready.isEmpty():
            cases = ready.select("case_id").distinct()
            own = p.join(cases, "case_id", "left_semi")
            ours = link.join(cases, "case_id", "left_semi")
            stops = ready.select("case_id", F.col("source").alias("node")).unionByName(ready.select("case_id", F.col("goal").alias("node")))
            for c in ("src", "dst"):
                stops = stops.unionByName(ours.select("case_id", F.col(c).alias("node")))
            new = stored(_points_of(own, nodes, stops.distinct(), ours, ready), "paths")
            paths = new if paths is None else paths.unionByName(new)
            waiting = stored(waiting.join(ready, ["case_id", "pair"], "left_anti"), "legs")
        if waiting.isEmpty():
            break
    if paths is None:
        found = whole
    else:
        found = whole.unionByName(_joined_legs(paths, outer, detour))
    return _trimmed(stored(found, "found"), targets)


def with_nodes_at():
    """Node number of a query's position."""
    from .graph import packed_milli

    return packed_milli(AT)


def _points_of(points, nodes, stops, links, pairs):
    """Points of the shortest paths: (case_id, pair, seq, x, y, z, rad)."""
    p, runs = contracted(points, stops)
    edge = runs.select("case_id", "src", "dst", "w").unionByName(links)
    way = stored(paths_to_goals(edge, pairs), "ways")
    last = way.select("case_id", "pair", (F.col("place") + 1).alias("place"), F.col("node").alias("prev"))
    hop = way.join(last, ["case_id", "pair", "place"]).withColumns({"src": F.least("node", "prev"), "dst": F.greatest("node", "prev")})
    # A hop is the run between its nodes unless a link is shorter.
    over = links.groupBy("case_id", "src", "dst").agg(F.min("w").alias("_link"))
    hop = hop.join(runs, ["case_id", "src", "dst"], "left").join(over, ["case_id", "src", "dst"], "left")
    by_run = F.col("w").isNotNull() & (F.col("_link").isNull() | (F.col("w") <= F.col("_link")))
    hop = hop.withColumn("_run", by_run).withColumn("_n", F.when(by_run, F.col("s1") - F.col("s0")).otherwise(1).cast("bigint"))
    hop = stored(running(hop, ["case_id", "pair"], "place", {"_to": F.col("_n")}), "hops")
    ahead = F.col("forward") == (F.col("prev") < F.col("node"))
    inside = hop.where("_run").select(*KEYS, "pair", "seg", "s0", "s1", (F.col("_to") - F.col("_n")).alias("_off"), ahead.alias("_ahead"))
    body = p.where("not stop").join(inside, [*KEYS, "seg"]).select(
        "case_id", "pair", (F.col("_off") + F.when(F.col("_ahead"), F.col("seq") - F.col("s0")).otherwise(F.col("s1") - F.col("seq"))).alias("seq"), *POS, "rad"
    )
    spot = hop.select("case_id", "pair", F.col("_to").alias("seq"), "node").unionByName(
        way.where("place = 0").select("case_id", "pair", F.lit(0).cast("bigint").alias("seq"), "node")
    )
    return body.unionByName(spot.join(nodes, ["case_id", "node"]).select("case_id", "pair", "seq", *POS, "rad"))


def _joined_legs(paths, outer, detour):
    """Leg 0 turned round, leg 1, leg 2 in one sequence; positions where legs meet stand once."""
    length = _length(paths)
    ends_ = paths.groupBy("case_id", "pair").agg(F.min_by(F.struct(*POS), "seq").alias("a"), F.max("seq").alias("_top")).join(length, ["case_id", "pair"])
    far = outer.select("case_id", (F.col("which") * 2).alias("pair"), *AT)
    leg = ends_.join(far, ["case_id", "pair"], "left")
    fits = (F.col("pair") == 1) | (F.col("length") < detour * g.dist(g.vec("a.x", "a.y", "a.z"), g.vec(*AT)))
    leg = leg.where(fits).select("case_id", "pair", "_top")
    tops = leg.groupBy("case_id").agg(*[F.max(F.when(F.col("pair") == k, F.col("_top"))).alias(f"_t{k}") for k in (0, 1)]).where("_t1 is not null")
    p = paths.join(leg, ["case_id", "pair"]).join(tops, "case_id").where("pair = 1 or seq > 0")
    before = F.coalesce("_t0", F.lit(0))
    place = F.when(F.col("pair") == 0, F.col("_top") - F.col("seq")).when(F.col("pair") == 1, before + F.col("seq")).otherwise(before + F.col("_t1") + F.col("seq"))
    return p.select("case_id", place.cast("bigint").alias("seq"), *POS, "rad")


def _length(paths):
    from .traces import accumulated_length

    acc = accumulated_length(paths.withColumnRenamed("pair", "trace_id"))
    return acc.groupBy("case_id", F.col("trace_id").alias("pair")).agg(F.max("acc").alias("length"))


def _trimmed(trace, targets):
    """Between the points nearest to the head and to the end, head first; a target goes after a last point."""
    t = targets.where(F.col("which") < 2).select("case_id", "which", *AT)
    near = trace.join(t, "case_id").groupBy("case_id", "which").agg(
        F.min(F.struct(g.dist(g.vec(*POS), g.vec(*AT)).alias("d"), "seq")).alias("m"), F.max("seq").alias("top")
    )
    cut = near.groupBy("case_id").agg(F.max("top").alias("top"), *[F.max(F.when(F.col("which") == k, F.col("m.seq"))).alias(n) for k, n in ((0, "a"), (1, "b"))])
    cut = cut.where("a is not null and b is not null").withColumn("turn", F.expr("a > b"))
    seq = F.when(F.col("turn"), F.col("top") - F.col("seq")).otherwise(F.col("seq"))
    flip = lambda c: F.when(F.col("turn"), F.col("top") - F.col(c)).otherwise(F.col(c))
    cut = stored(cut.withColumns({"a": flip("a"), "b": flip("b")}), "cuts")
    # The point nearest to the end goes when the trace runs on beyond it.
    body = trace.join(cut, "case_id").withColumn("seq", seq).where("seq >= a and (seq < b or b = top)")
    put = lambda k: t.where(F.col("which") == k).select("case_id", *[F.col(q).alias(c) for q, c in zip(AT, POS)])
    first = body.groupBy("case_id").agg(F.min_by("rad", "seq").alias("r0"), F.max_by("rad", "seq").alias("r1"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
    first = first.join(cut, "case_id")
    head = put(0).join(first.where("a = 0"), "case_id").select("case_id", (F.col("s0") - 1).alias("seq"), *POS, F.col("r0").alias("rad"))
    tail = put(1).join(first.where("b = top"), "case_id").select("case_id", (F.col("s1") + 1).alias("seq"), *POS, F.col("r1").alias("rad"))
    all_ = body.select("case_id", "seq", *POS, "rad").unionByName(head).unionByName(tail)
    low = all_.groupBy("case_id").agg(F.min("seq").alias("_low"))
    return all_.join(low, "case_id").select("case_id", (F.col("seq") - F.col("_low")).alias("seq"), *POS, "rad")
