"""Graphs of traces and voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from ..plans.blocks import BLOCK, neighbours, ranked, running
from ..plans.graphloop import chain_ranks, components, distances_within, list_ranks, rooted, spanning_forest
from ..plans.voxelgrid import TWENTY_SIX, neighbour_edges, packed, with_position
from ..session import stored
from .matching import AT, as_queries, ends, nearest_other, neighbour_segments, representative, sample_sets, trace_distance
from .points import path_sets
from .traces import KEYS, POS, shifted, with_step


def milli_id() -> Column:
    """Node number of a position: thousandths packed into one integer; raises beyond |coordinate| < 1048."""
    return packed_milli(POS)


def packed_milli(names) -> Column:
    return packed([F.round(F.col(c) * 1000).cast("bigint") for c in names])


def with_nodes(points: DataFrame) -> DataFrame:
    return points.withColumn("node", milli_id())


def node_graph(points: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Nodes (one per position, radius of the last point there) and edges between successive points."""
    p = with_nodes(points)
    nodes = p.groupBy("case_id", "node").agg(*[F.first(c).alias(c) for c in POS], F.max_by("rad", F.struct("trace_id", "seq")).alias("rad"))
    s = neighbours(with_step(p, size), KEYS, "seq", {"_prev": ("node", -1)}, size).where("_prev is not null and _prev <> node")
    e = s.groupBy("case_id", F.least("node", "_prev").alias("src"), F.greatest("node", "_prev").alias("dst")).agg(F.min("step").alias("dist"))
    return nodes, e


def node_degree(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """Points with ``degree``: how often their position is named as a neighbour."""
    p = with_nodes(points)
    near = neighbours(p, KEYS, "seq", {"_a": ("node", -1), "_b": ("node", 1)}, size)
    told = near.select("case_id", F.explode(F.array_compact(F.array("_a", "_b"))).alias("node"))
    deg = told.groupBy("case_id", "node").agg(F.count("*").alias("degree"))
    return p.join(deg, ["case_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def simple_degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per node."""
    both = edges.select("case_id", F.col("src").alias("node")).unionByName(edges.select("case_id", F.col("dst").alias("node")))
    return both.groupBy("case_id", "node").agg(F.count("*").alias("deg"))


def simplified_graph(points: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Contract chains of degree-2 nodes.

    Nodes of degree other than 2 (``deg``) and the chains between them: total length, mean
    radius, chord direction with z >= 0 as one of 26, number of points, label of the middle.
    Of parallel chains the last (trace, position) is kept.
    """
    p = with_nodes(points)
    _, e = node_graph(points, size)
    e = stored(e, "edges")
    deg = stored(simple_degree(e), "degree")
    keep = deg.where("deg <> 2")
    q = p.join(keep.select("case_id", "node", "deg"), ["case_id", "node"], "left")
    near = shifted(q, [-1], [*POS], size).withColumn("step", g.dist(g.vec(*POS), g.vec("p1_x", "p1_y", "p1_z"))).drop("p1_x", "p1_y", "p1_z")
    stop = F.col("deg").isNotNull()
    # Segment k holds the steps after stop k - 1 up to stop k.
    r = running(near, KEYS, "seq", {"_c": stop.cast("bigint")}, size=size).withColumn("seg", F.col("_c") - stop.cast("bigint"))
    r = stored(r, "chains")
    whole = r.where("_c > 0 and seg > 0")
    part = whole.groupBy(*KEYS, "seg").agg(
        F.sum("step").alias("dist"), F.avg("rad").alias("_r"), F.count("*").alias("n"), F.max(F.when(stop, F.col("node"))).alias("dst"), F.max("seq").alias("last_seq"),
        *[F.max(F.when(stop, F.col(c))).alias(f"b{c}") for c in POS],
    ).where("dst is not null")
    start = r.where(stop).select(*KEYS, F.col("_c").alias("seg"), F.col("node").alias("src"), *[F.col(c).alias(f"a{c}") for c in POS])
    c = part.join(start, [*KEYS, "seg"])
    d = g.sub(g.vec("bx", "by", "bz"), g.vec("ax", "ay", "az"))
    up = tuple(F.when(d[2] < 0, -v).otherwise(v) for v in d)
    c = c.withColumns({"dir": g.best_direction(up), "a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).where("a <> b")
    last = c.groupBy("case_id", "a", "b").agg(F.max(F.struct("trace_id", "last_seq", "dist", F.col("_r").alias("rad"), "n", "dir", "seg")).alias("m"))
    edges = last.select("case_id", F.col("a").alias("src"), F.col("b").alias("dst"), "m.dist", "m.rad", "m.n", "m.dir", "m.trace_id", "m.last_seq")
    nodes = p.join(keep, ["case_id", "node"]).groupBy("case_id", "node").agg(*[F.first(c).alias(c) for c in POS], F.first("deg").alias("deg"), F.avg("rad").alias("rad"))
    return nodes, edges


def keep_large_components(edges: DataFrame, least_length: float = 100, least_nodes: int = 5) -> DataFrame:
    """Edges of components longer than ``least_length`` with more than ``least_nodes`` nodes; all if a case has none."""
    comp = stored(components(edges), "components")
    n = comp.groupBy("case_id", "comp").agg(F.count("*").alias("nodes"))
    e = edges.join(comp.select("case_id", F.col("node").alias("src"), "comp"), ["case_id", "src"])
    ln = e.groupBy("case_id", "comp").agg(F.sum("dist").alias("length"))
    ok = n.join(ln, ["case_id", "comp"]).withColumn("ok", (F.col("length") > least_length) & (F.col("nodes") > least_nodes))
    any_ = ok.groupBy("case_id").agg(F.bool_or("ok").alias("any"))
    return e.join(ok.join(any_, "case_id").where("ok or not any").select("case_id", "comp"), ["case_id", "comp"])


def same_vessel(pairs: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path length below 1.2 times the straight distance + 3: ``pairs(case_id, source, node)``."""
    at = lambda n, t: nodes.select("case_id", F.col("node").alias(n), *[F.col(c).alias(f"{t}{c}") for c in POS])
    w = pairs.join(at("source", "a"), ["case_id", "source"]).join(at("node", "b"), ["case_id", "node"])
    w = w.join(paths.select("case_id", "source", "node", "dist"), ["case_id", "source", "node"], "left")
    straight = g.dist(g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz"))
    return w.select("case_id", "source", "node", F.coalesce(F.col("dist") < 1.2 * straight + 3, F.lit(False)).alias("same_vessel"))


def trace_adjacency(points: DataFrame, r: float) -> DataFrame:
    """Pairs of traces with points closer than ``r`` and their least distance."""
    return trace_distance(points, r).select("case_id", F.col("trace_a").alias("src"), F.col("trace_b").alias("dst"), F.col("dist").alias("w"))


def main_tree(points: DataFrame, r: float = 20, more_than: int = 5) -> DataFrame:
    """Traces of components with more than ``more_than`` traces and a central mean position.

    Central: less than 1.645 deviations from the mean trace centroid in x and in y (a normal
    tail above 0.05).  Without a valid component the largest one stays.
    """
    cen = stored(points.groupBy(*KEYS).agg(*[F.avg(c).alias(f"c{c}") for c in POS]), "centroids")
    comp = components(trace_adjacency(points, r), cen.select("case_id", F.col("trace_id").alias("node")))
    t = stored(cen.join(comp.withColumnRenamed("node", "trace_id"), KEYS), "members")
    case = t.groupBy("case_id").agg(*[f.alias(n) for c in "xy" for f, n in ((F.avg(f"c{c}"), f"m{c}"), (F.stddev_pop(f"c{c}"), f"s{c}"))])
    per = t.groupBy("case_id", "comp").agg(F.count("*").alias("n"), F.avg("cx").alias("gx"), F.avg("cy").alias("gy"))
    big = per.groupBy("case_id").agg(F.max("n").alias("top"), F.max(F.struct("n", (-F.col("comp")).alias("c"))).alias("_b"))
    w = per.join(case, "case_id").join(big, "case_id")
    near = lambda c: F.abs(F.col(f"g{c}") - F.col(f"m{c}")) < 1.6448536269514722 * F.col(f"s{c}")
    ok = (F.col("n") > F.least(F.lit(more_than), F.col("top") - 1)) & near("x") & near("y")
    w = w.withColumn("ok", ok)
    any_ = w.groupBy("case_id").agg(F.bool_or("ok").alias("any"))
    keep = w.join(any_, "case_id").where(F.col("ok") | (~F.col("any") & (F.col("comp") == -F.col("_b.c"))))
    return t.join(keep.select("case_id", "comp"), ["case_id", "comp"]).select(*KEYS, "comp")


def merge_chains(points: DataFrame) -> DataFrame:
    """Where two trace ends share a truncated position: (case_id, key, first, second) pairs.

    Only positions met by exactly two ends of different traces are joined, so the chains
    do not depend on an order.
    """
    e = ends(points).withColumn("key", g.truncated_key(g.vec(*POS)))
    per = e.groupBy("case_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("trace_id", "end")).alias("a"), F.max(F.struct("trace_id", "end")).alias("b"))
    return per.where("n = 2 and a.trace_id <> b.trace_id").select("case_id", "key", F.col("a.trace_id").alias("ta"), F.col("a.end").alias("ea"), F.col("b.trace_id").alias("tb"), F.col("b.end").alias("eb"))


def chain_plan(points: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, trace_id, chain, place, turn): where each trace stands in its chain and whether it is turned.

    Walking a trace from one end to the other and on over a link is a step of a list; both ways
    are ranked by pointer doubling.  A chain starts at the end trace with the lower id; a closed one
    opens at its least trace, which keeps its direction.  ``chain`` is the least trace.
    """
    side = links.select("case_id", F.col("ta").alias("t"), F.col("ea").alias("e"), F.col("tb").alias("t2"), F.col("eb").alias("e2"))
    side = stored(side.unionByName(side.select("case_id", F.col("t2").alias("t"), F.col("e2").alias("e"), F.col("t").alias("t2"), F.col("e").alias("e2"))), "sides")
    every = points.select("case_id", F.col("trace_id").alias("node")).distinct()
    comp = stored(components(links.select("case_id", F.col("ta").alias("src"), F.col("tb").alias("dst")), every), "chains")
    deg = side.groupBy("case_id", F.col("t").alias("node")).agg(F.count("*").alias("deg"))
    start = comp.join(deg, ["case_id", "node"], "left").groupBy("case_id", "comp").agg(
        F.min(F.when(F.coalesce("deg", F.lit(0)) < 2, F.col("node"))).alias("open"), F.min("node").alias("least")
    ).select("case_id", "comp", F.coalesce("open", "least").alias("source"), F.col("open").isNull().alias("ring"))
    start = stored(start, "starts")
    # A state enters trace t at end e and leaves it at the other end.
    states = every.select("case_id", F.col("node").alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("e"))
    leave = side.select("case_id", "t", (1 - F.col("e")).alias("e"), F.struct(F.col("t2").alias("t"), F.col("e2").alias("e")).alias("next"))
    ring = start.where("ring").select("case_id", F.col("source").alias("r"))
    heads = ring.select("case_id", F.struct(F.col("r").alias("t"), F.lit(0).alias("e")).alias("next"), F.lit(True).alias("_cut"))
    tails = ring.select("case_id", F.col("r").alias("t"), F.lit(1).alias("e"), F.lit(True).alias("_end"))
    links_ = states.join(leave, ["case_id", "t", "e"], "left").join(heads, ["case_id", "next"], "left").join(tails, ["case_id", "t", "e"], "left")
    links_ = links_.select("case_id", F.struct("t", "e").alias("at"), F.when(F.col("_cut").isNull() & F.col("_end").isNull(), F.col("next")).alias("next"))
    ranks = list_ranks(links_).select("case_id", F.col("at.t").alias("node"), F.col("at.e").alias("e"), F.col("last.t").alias("source"), F.col("steps").alias("place"))
    # The state that walks towards the source enters the trace at the end where the chain leaves it.
    toward = ranks.join(comp, ["case_id", "node"]).join(start, ["case_id", "comp", "source"])
    return toward.groupBy("case_id", F.col("node").alias("trace_id"), F.col("comp").alias("chain")).agg(
        F.min("place").alias("place"), (F.max_by("e", F.struct(-F.col("place"), "e")) == 0).alias("turn")
    )


def merge_at_ends(points: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Join chains of traces linked end to end into one trace each, named by its least trace.

    ``links(case_id, ta, ea, tb, eb)``, each end in one link at most; by default ends that share a position.
    """
    links = stored(merge_chains(points) if links is None else links, "links")
    size = points.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    plan = stored(chain_plan(points, links).join(size, KEYS), "plan")
    off = running(plan, ["case_id", "chain"], "place", {"_to": F.col("_n")}).select(*KEYS, "chain", "turn", "_n", (F.col("_to") - F.col("_n")).alias("_off"))
    seq = F.col("_off") + F.when(F.col("turn"), F.col("_n") - 1 - F.col("seq")).otherwise(F.col("seq"))
    return points.join(off, KEYS).withColumn("seq", seq).withColumn("trace_id", F.col("chain")).drop("chain", "turn", "_n", "_off")


def unambiguous(pairs: DataFrame) -> DataFrame:
    """Accepted neighbour pairs (case_id, a, b) whose traces appear in one pair only."""
    both = pairs.select("case_id", F.col("a").alias("t")).unionByName(pairs.select("case_id", F.col("b").alias("t")))
    many = both.groupBy("case_id", "t").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    one = pairs.join(many.withColumnRenamed("t", "a"), ["case_id", "a"], "left_anti")
    return one.join(many.withColumnRenamed("t", "b"), ["case_id", "b"], "left_anti")


def voxel_graph(skeleton: DataFrame) -> DataFrame:
    """Edges between 26-neighbouring skeleton voxels with their length."""
    e = neighbour_edges(skeleton, TWENTY_SIX)
    a = with_position(e.withColumn("node", F.col("src"))).withColumnsRenamed({c: f"a{c}" for c in POS}).drop("node")
    b = with_position(a.withColumn("node", F.col("dst"))).drop("node")
    d = g.dist(tuple(F.col(c).cast("double") for c in POS), tuple(F.col(f"a{c}").cast("double") for c in POS))
    return b.withColumn("dist", d).select("case_id", "src", "dst", "dist")


def traces_from_graph(edges: DataFrame) -> DataFrame:
    """Chains between nodes of degree other than 2: (case_id, chain, seq, node).

    Pieces of degree-2 nodes are components of the graph without its other nodes; their order
    comes from list ranking.  Rings without any such node open at their least node and go on to
    its lesser neighbour.
    """
    e = stored(edges.select("case_id", "src", "dst"), "edges")
    deg = stored(simple_degree(e), "degree")
    mid = deg.where("deg = 2").select("case_id", "node")
    s = e.join(mid.withColumnRenamed("node", "src").withColumn("_a", F.lit(True)), ["case_id", "src"], "left").join(
        mid.withColumnRenamed("node", "dst").withColumn("_b", F.lit(True)), ["case_id", "dst"], "left"
    ).select("case_id", "src", "dst", F.coalesce("_a", F.lit(False)).alias("ma"), F.coalesce("_b", F.lit(False)).alias("mb"))
    s = stored(s, "sides")
    inner = s.where("ma and mb").select("case_id", "src", "dst")
    comp = stored(components(inner, mid), "pieces")
    # Where a piece touches a junction or an end.
    touch = s.where("ma <> mb").select("case_id", F.when(F.col("ma"), F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(F.col("ma"), F.col("dst")).otherwise(F.col("src")).alias("hub"))
    touch = stored(touch.join(comp, ["case_id", "node"]), "touch")
    start = touch.groupBy("case_id", "comp").agg(F.min(F.struct("node", "hub")).alias("f"), F.max(F.struct("node", "hub")).alias("l"), F.count("*").alias("k"))
    ring = comp.groupBy("case_id", "comp").agg(F.min("node").alias("least")).join(start, ["case_id", "comp"], "left")
    plan = stored(ring.select("case_id", "comp", F.coalesce(F.col("f.node"), F.col("least")).alias("source"), F.col("f.hub").alias("hub0"),
                              F.when(F.col("k") > 1, F.col("l.hub")).alias("hub1")), "plan")
    place = chain_ranks(inner, plan.select("case_id", "source"))
    body = place.join(plan, ["case_id", "source"]).select("case_id", F.col("comp").alias("chain"), (F.col("hops") + F.when(F.col("hub0").isNotNull(), 1).otherwise(0)).alias("seq"), "node")
    size = body.groupBy("case_id", "chain").agg(F.max("seq").alias("_m"))
    first = plan.where("hub0 is not null").select("case_id", F.col("comp").alias("chain"), F.lit(0).cast("bigint").alias("seq"), F.col("hub0").alias("node"))
    last = plan.where("hub1 is not null").join(size.withColumnRenamed("chain", "comp"), ["case_id", "comp"]).select("case_id", F.col("comp").alias("chain"), (F.col("_m") + 1).alias("seq"), F.col("hub1").alias("node"))
    # A link between two junctions has no inner node to be named by: it gets a negative number, written once.
    direct = stored(s.where("not ma and not mb").select("case_id", (-1 - F.monotonically_increasing_id()).alias("chain"), "src", "dst"), "direct")
    direct = direct.select("case_id", "chain", F.posexplode(F.array("src", "dst")).alias("seq", "node"))
    return body.unionByName(first).unionByName(last).unionByName(direct.withColumn("seq", F.col("seq").cast("bigint")))


def end_links(points: DataFrame, r: float = 10.0, values: DataFrame | None = None, gate: float = 0.5) -> DataFrame:
    """Nearest join within ``r`` for each trace end: end to end or end to body.

    With ``values(case_id, x, y, z, v)`` (a cost volume) links whose straight path has a mean
    cost of ``gate`` or more are dropped.
    """
    e = stored(ends(points), "ends")
    q = as_queries(e, keep=["end"]).dropDuplicates(["case_id", "q_trace_id", "q_seq"])
    last = points.groupBy(*KEYS).agg(F.max("seq").alias("last"))
    hit = nearest_other(q, points, r, keep=POS).join(last, KEYS)
    kind = F.when((F.col("seq") == 0) | (F.col("seq") == F.col("last")), "end").otherwise("body")
    out = hit.join(q, ["case_id", "q_trace_id", "q_seq"]).withColumn("kind", kind)
    cols = ["case_id", "q_trace_id", "q_end", "trace_id", "seq", "kind", "dist"]
    if values is None:
        return out.select(*cols)
    links = out.select("case_id", "q_trace_id", "q_end", *[F.col(f"q{c}").alias(f"a{c}") for c in POS], *[F.col(c).alias(f"b{c}") for c in POS])
    cost = sample_sets(path_sets(links), values, "v", ["case_id", "q_trace_id", "q_end"], "k").groupBy("case_id", "q_trace_id", "q_end").agg(F.avg("v").alias("cost"))
    return out.join(cost, ["case_id", "q_trace_id", "q_end"]).where(F.col("cost") < gate).select(*cols, "cost")


def mutual_links(candidates: DataFrame, below: float) -> DataFrame:
    """Accept links that are the cheapest for both sides, in rounds, while their loss is below ``below``.

    ``candidates(case_id, a, b, loss)``: a, b name trace ends (or a trace body); an accepted
    end is used up.  Every round accepts the cheapest link at least; they end when none is left.
    """
    c = candidates.where(F.col("loss") < below).select("case_id", "a", "b", "loss")
    c = stored(c, "candidates")
    done = None
    while True:
        side = c.select("case_id", F.col("a").alias("e"), "loss", "a", "b").unionByName(c.select("case_id", F.col("b").alias("e"), "loss", "a", "b"))
        best = side.groupBy("case_id", "e").agg(F.min(F.struct("loss", "a", "b")).alias("m"))
        pick = best.select("case_id", "m.*").groupBy("case_id", "loss", "a", "b").agg(F.count("*").alias("n")).where("n = 2").drop("n")
        pick = stored(pick, "links")
        if not pick.limit(1).count():
            break
        done = pick if done is None else done.unionByName(pick)
        used = pick.select("case_id", F.col("a").alias("e")).unionByName(pick.select("case_id", F.col("b").alias("e")))
        c = c.join(used.withColumnRenamed("e", "a"), ["case_id", "a"], "left_anti").join(used.withColumnRenamed("e", "b"), ["case_id", "b"], "left_anti")
        c = stored(c, "candidates")
    return c.limit(0) if done is None else done


def cut_loops(points: DataFrame, r: float, weight: str = "w") -> DataFrame:
    """Trace links kept by the minimum spanning forest of trace adjacency."""
    return spanning_forest(trace_adjacency(points, r), weight)


def without_loops(points: DataFrame, r: float = 17.0, size: int = BLOCK) -> DataFrame:
    """Traces cut and joined so that their positions form a forest.

    Edges are the steps of the traces and, for each trace end, the way to the nearest point of
    another trace within ``r``.  The minimum spanning forest keeps the shortest; a trace is split at every
    step outside it, which cuts a loop at its longest edge, and an end gets the
    point that a link in it leads to.  Returns the points with ``node``; ``trace_id`` is new where a
    trace was split (``from_trace`` is the old one).  Pieces of one point whose position another piece has are dropped.
    """
    p = stored(with_nodes(points.select(*KEYS, "seq", *POS, "rad")), "nodes")
    steps = stored(node_graph(points, size)[1], "steps").select("case_id", "src", "dst", F.col("dist").alias("w"))
    e = ends(p)
    q = as_queries(e, keep=["end", "node"])
    hit = nearest_other(q.dropDuplicates(["case_id", "q_trace_id", "q_seq"]), p, r, keep=("rad", "node", *POS)).select(
        "case_id", "q_trace_id", "q_seq", "dist", F.col("node").alias("to"), *[F.col(c).alias(f"t{c}") for c in POS], F.col("rad").alias("t_rad")
    )
    hit = hit.join(q.select("case_id", "q_trace_id", "q_seq", "q_end", "q_node"), ["case_id", "q_trace_id", "q_seq"]).where("q_node <> to")
    link = hit.withColumns({"src": F.least("q_node", "to"), "dst": F.greatest("q_node", "to")})
    # An edge is a link of one end only, and no link where a trace already goes that way.
    link = link.groupBy("case_id", "src", "dst").agg(F.min(F.struct("q_trace_id", "q_end", "dist", "tx", "ty", "tz", "t_rad", "to")).alias("m")).select("case_id", "src", "dst", "m.*")
    link = stored(link.join(steps, ["case_id", "src", "dst"], "left_anti"), "links")
    forest = stored(spanning_forest(steps.unionByName(link.select("case_id", "src", "dst", F.col("dist").alias("w")))).select("case_id", "src", "dst"), "forest")
    # A point whose step is outside the forest begins a piece.
    near = neighbours(p, KEYS, "seq", {"_prev": ("node", -1)}, size).withColumns({"src": F.least("node", "_prev"), "dst": F.greatest("node", "_prev")})
    near = near.join(forest.withColumn("_kept", F.lit(1)), ["case_id", "src", "dst"], "left")
    cut = (F.col("_prev").isNotNull() & (F.col("_prev") != F.col("node")) & F.col("_kept").isNull()).cast("bigint")
    piece = running(near.withColumn("_cut", cut), KEYS, "seq", {"piece": F.col("_cut")}, size=size).drop("src", "dst", "_prev", "_kept", "_cut")
    # Links of the forest go on where their end is.
    joined = link.join(forest, ["case_id", "src", "dst"], "left_semi").select(
        "case_id", F.col("q_trace_id").alias("trace_id"), F.col("q_end").alias("end"), *[F.col(f"t{c}").alias(c) for c in POS], F.col("t_rad").alias("rad"), F.col("to").alias("node")
    )
    piece = stored(piece, "pieces")
    tips = ends(piece).select(*KEYS, "end", "seq", "piece")
    more = joined.join(tips, [*KEYS, "end"]).withColumn("seq", F.when(F.col("end") == 0, F.lit(-1)).otherwise(F.col("seq") + 1).cast("bigint"))
    cols = [*KEYS, "piece", "seq", *POS, "rad", "node"]
    whole = stored(piece.select(cols).unionByName(more.select(cols)), "pieces")
    count = whole.groupBy(*KEYS, "piece").agg(F.count_distinct("node").alias("n"), F.min("seq").alias("s0"))
    whole = whole.join(count, [*KEYS, "piece"])
    long, short = whole.where("n > 1"), whole.where("n = 1 and seq = s0")
    lone = short.join(long.select("case_id", "node"), ["case_id", "node"], "left_anti").groupBy("case_id", "node").agg(
        F.min(F.struct("trace_id", "piece", "seq", *POS, "rad", "s0")).alias("m")
    ).select("case_id", "m.*", "node")
    kept = stored(long.drop("n").unionByName(lone), "kept")
    names = ranked(kept.select(*KEYS, "piece", "s0").distinct(), [F.col("case_id"), F.col("trace_id"), F.col("piece")], "_name")
    return kept.join(names, [*KEYS, "piece", "s0"]).select(
        "case_id", (F.col("_name") - 1).alias("trace_id"), (F.col("seq") - F.col("s0")).alias("seq"), *POS, "rad", "node", F.col("trace_id").alias("from_trace")
    )


def with_parents(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """Traces without loops, with ``parent``: the node before each position on the way from the root of its tree.

    A tree hangs from its widest position (ties: the lowest node); the root's parent is NULL.
    """
    nodes, edges = node_graph(points, size)
    edges = stored(edges.select("case_id", "src", "dst"), "edges")
    comp = components(edges, nodes.select("case_id", "node"))
    top = nodes.join(comp, ["case_id", "node"]).groupBy("case_id", "comp").agg(F.max(F.struct("rad", (-F.col("node")).alias("k"))).alias("m"))
    parent = rooted(edges, top.select("case_id", (-F.col("m.k")).alias("node")))
    return with_nodes(points).join(parent, ["case_id", "node"], "left")


def labelled_candidates(points: DataFrame, reference: DataFrame, r: float = 15.0) -> DataFrame:
    """Neighbour segments of every trace tail and whether the reference joins the two ends.

    Both ends are represented by a reference point; they belong together if the way between
    these over the reference traces is below 1.2 times the straight distance + 3.  Only ways
    up to such bounds are searched.
    """
    near = stored(neighbour_segments(points, r), "neighbours")
    rep = representative(points, reference).where("ref_trace >= 0")
    ref = stored(with_nodes(reference), "reference")
    at = ref.select("case_id", F.col("trace_id").alias("ref_trace"), F.col("seq").alias("ref_seq"), "node", *POS)
    rep = stored(rep.join(at, ["case_id", "ref_trace", "ref_seq"]).select(*KEYS, "end", "node", *POS), "representatives")
    mine = rep.where("end = 1").select("case_id", F.col("trace_id").alias("q_trace_id"), F.col("node").alias("source"), *[F.col(c).alias(f"a{c}") for c in POS])
    other = rep.select(*KEYS, F.col("end").alias("reversed"), "node", *[F.col(c).alias(f"b{c}") for c in POS])
    pair = mine.join(near, ["case_id", "q_trace_id"]).join(other, [*KEYS, "reversed"], "left")
    pair = stored(pair.withColumn("most", 1.2 * g.dist(g.vec("ax", "ay", "az"), g.vec("bx", "by", "bz")) + 3), "pairs")
    edges = node_graph(reference)[1].select("case_id", "src", "dst", F.col("dist").alias("w"))
    ways = distances_within(edges, pair.select("case_id", "source", "node", "most")).withColumnRenamed("dist", "way")
    return pair.join(ways, ["case_id", "source", "node"], "left").select(
        "case_id", "q_trace_id", "trace_id", "reversed", F.coalesce(F.col("way") < F.col("most"), F.lit(False)).alias("same_vessel")
    )
