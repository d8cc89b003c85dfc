"""Compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.blocks import renumber
from ..plans.graphloop import spanning_forest
from ..plans.voxelgrid import with_position
from ..session import stored
from . import editing as ed, graph as gr, matching as mt, traces as tr
from .cutting import intensity_cuts
from .points import path_sets
from .volumes import top_components

BASE = ["case_id", "trace_id", "seq", "x", "y", "z", "rad"]


def mask_to_traces(voxels: DataFrame, skeleton: DataFrame, least: int = 3) -> DataFrame:
    """Largest skeleton piece to graph, chains, radii from the mask, cuts and clean traces."""
    main = top_components(skeleton, 1).drop("place")
    chains = stored(gr.traces_from_graph(gr.voxel_graph(main)), "chains")
    p = with_position(chains).select("case_id", F.col("chain").alias("trace_id"), "seq", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    rad = mt.radius_from_mask(p, voxels.where("intensity > 12"), ["case_id", "trace_id", "seq"])
    p = stored(p.join(rad.withColumnRenamed("fit_rad", "rad"), ["case_id", "trace_id", "seq"]), "traces")
    sig = mt.sample(p, voxels, "intensity", ["case_id", "trace_id", "seq"], linear=False).withColumnRenamed("v", "signal")
    cut = intensity_cuts(p.join(sig, ["case_id", "trace_id", "seq"]), "signal")
    named = cut.withColumn("trace_id", F.xxhash64("trace_id", "piece")).select(*BASE)
    return tr.remove_short(tr.remove_duplicate_points(stored(named, "pieces")), least - 1)


def traces_to_tree(points: DataFrame, voxels: DataFrame, r: float = 5.0, most_loss: float = 1.0) -> DataFrame:
    """Candidate links between ends and other traces, spanning forest by loss, branches, clean-up."""
    p = stored(points, "traces")
    e = stored(mt.ends(p).select("case_id", "trace_id", "end", "last_seq", "seq", "x", "y", "z"), "ends")
    q = mt.as_queries(e, keep=["end"]).dropDuplicates(["case_id", "q_trace_id", "q_end"])
    near = mt.nearest_per_trace(q.drop("q_end").distinct(), p, r)
    cand = near.join(q.select("case_id", "q_trace_id", "q_seq", "q_end", "qx", "qy", "qz"), ["case_id", "q_trace_id", "q_seq"])
    cand = cand.join(p.select("case_id", "trace_id", "seq", "x", "y", "z", F.col("rad").alias("t_rad")), ["case_id", "trace_id", "seq"])
    cand = stored(cand, "candidates")
    # The end must be the point of its own trace that is nearest to the target.
    back = cand.select("case_id", F.struct("q_trace_id", "q_end", F.col("trace_id").alias("t")).alias("q_id"), F.col("q_trace_id").alias("trace_id"),
                       F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))
    first = mt.nearest_in_trace(back, p, r).select("case_id", F.col("q_id.q_trace_id").alias("q_trace_id"), F.col("q_id.q_end").alias("q_end"), F.col("q_id.t").alias("trace_id"), F.col("seq").alias("own"))
    cand = cand.join(first, ["case_id", "q_trace_id", "q_end", "trace_id"]).where("own = q_seq")
    links = cand.select("case_id", F.col("q_trace_id").alias("trace_a"), F.col("trace_id").alias("trace_b"), "q_end", *[F.col(f"q{c}").alias(f"a{c}") for c in "xyz"], *[F.col(c).alias(f"b{c}") for c in "xyz"])
    links = stored(links, "links")
    bad = mt.crossing_links(links, mt.paint_unique(p))
    cost = mt.sample_sets(path_sets(links), voxels, "score", ["case_id", "trace_a", "trace_b", "q_end"], "k").groupBy("case_id", "trace_a", "trace_b", "q_end").agg((1 - F.avg("v")).alias("loss"))
    scored = cand.withColumnsRenamed({"q_trace_id": "trace_a", "trace_id": "trace_b"}).join(cost, ["case_id", "trace_a", "trace_b", "q_end"]).join(bad, ["case_id", "trace_a", "trace_b"], "left_anti")
    scored = stored(scored.withColumn("loss", F.when(F.col("dist") < 0.1, F.lit(0.0)).otherwise(F.col("loss"))), "scored")
    forest = spanning_forest(scored.select("case_id", F.col("trace_a").alias("src"), F.col("trace_b").alias("dst"), F.col("loss").alias("w")))
    pick = scored.withColumns({"src": F.least("trace_a", "trace_b"), "dst": F.greatest("trace_a", "trace_b"), "w": F.col("loss")}).join(forest, ["case_id", "src", "dst", "w"])
    pick = pick.where((F.col("dist") != 0) & (F.col("loss") < most_loss)).groupBy("case_id", "trace_a", F.col("q_end").alias("end")).agg(F.min(F.struct("loss", "trace_b", "x", "y", "z", "t_rad")).alias("m"))
    target = pick.select("case_id", F.col("trace_a").alias("trace_id"), "end", *[F.col(f"m.{c}").alias(f"t{c}") for c in "xyz"], "m.t_rad")
    p = stored(ed.branch_to(p, target), "branched")
    p = stored(tr.remove_self_loop(tr.remove_short(p, 3)), "cleaned")
    p = stored(gr.merge_at_ends(p).select(*BASE), "merged")
    p = tr.remove_short(ed.transfer(p, "length"), 3)
    return tr.resample(stored(p, "transferred"), 1.0)


def main_tree_without_loops(points: DataFrame, r: float = 10.0, more_than: int = 15, link: float = 17.0) -> DataFrame:
    """Branch and transfer at junctions, cut all loops, keep the main tree, merge what meets end to end.

    Returns the points with ``node`` and ``parent`` (the position before it on the way from the
    widest one of its tree).
    """
    c = mt.branch_candidates(points).select("case_id", F.col("q_trace_id").alias("a"), F.col("q_end").alias("end"), "trace_id", "seq")
    at = points.select("case_id", "trace_id", "seq", *[F.col(x).alias(f"t{x}") for x in "xyz"], F.col("rad").alias("t_rad"))
    target = c.join(at, ["case_id", "trace_id", "seq"]).drop("trace_id", "seq").withColumnRenamed("a", "trace_id")
    p = stored(ed.branch_to(points, target), "branched")
    p = stored(tr.remove_duplicate_points(p), "distinct")
    p = stored(ed.transfer(p, "length"), "transferred")
    p = stored(gr.without_loops(p, link).select(*BASE), "forest")
    p = p.join(gr.main_tree(p, r, more_than).select("case_id", "trace_id"), ["case_id", "trace_id"], "left_semi")
    p = stored(p, "main")
    # Only ends at one and the same position: a step between two positions could close a loop again.
    tip = gr.with_nodes(mt.ends(p)).select("case_id", "trace_id", "end", "node")
    side = lambda t: tip.select("case_id", F.col("trace_id").alias(f"t{t}"), F.col("end").alias(f"e{t}"), F.col("node").alias(f"n{t}"))
    links = gr.merge_chains(p).join(side("a"), ["case_id", "ta", "ea"]).join(side("b"), ["case_id", "tb", "eb"]).where("na = nb")
    p = stored(gr.merge_at_ends(p, links.select("case_id", "ta", "ea", "tb", "eb")).select(*BASE), "merged")
    return gr.with_parents(p)


def add_lower_threshold(high: DataFrame, low: DataFrame, least: int = 3) -> DataFrame:
    """Traces of a lower threshold where the higher one has none: duplicates are dropped with
    the higher threshold first, rests re-attached, ends merged, short traces removed."""
    both = stored(ed.union(high.select(*BASE), low.select(*BASE)), "both")
    clean = stored(ed.remove_duplicate_coverage(both), "coverage")
    named = clean.withColumn("trace_id", F.xxhash64("trace_id", "piece")).select(*BASE)
    dense = stored(renumber(named, tr.KEYS), "dense")
    return tr.remove_short(gr.merge_at_ends(dense).select(*BASE), least)


def labelled_graph(points: DataFrame, landmarks: DataFrame, training: bool = True):
    """Simplified graph with landmark types on nodes and vessel types on edges (0 in test mode)."""
    from .points import VESSEL_MERGE, relabel

    nodes, edges = gr.simplified_graph(points)
    edges = stored(gr.keep_large_components(stored(edges, "edges")), "kept")
    used = edges.select("case_id", F.col("src").alias("node")).unionByName(edges.select("case_id", F.col("dst").alias("node"))).distinct()
    lm = gr.with_nodes(landmarks).groupBy("case_id", "node").agg(F.min("lm_type").alias("lm_type"))
    kind = relabel(F.coalesce("lm_type", F.lit(0)), {}, above=22) if training else F.lit(0)
    nodes = nodes.join(used, ["case_id", "node"], "left_semi").join(lm, ["case_id", "node"], "left").withColumn("node_type", kind).drop("lm_type")
    label = points.select("case_id", "trace_id", "vestype").distinct()
    edges = edges.join(label, ["case_id", "trace_id"]).withColumn("vestype", relabel(F.col("vestype"), VESSEL_MERGE) if training else F.lit(0))
    return nodes, edges


def greedy_links(points: DataFrame, voxels: DataFrame, r: float = 30.0, below: float = -0.3) -> DataFrame:
    """Mutual best links of trace ends with the nearest point of every other trace within ``r``.

    Only targets count to which the end is the nearest point of its own trace.  Returns
    (case_id, loss, a, b): ``a`` names trace and end, ``b`` trace and position.
    """
    p = stored(points, "traces")
    q = mt.as_queries(mt.ends(p), keep=["end"]).groupBy("case_id", "q_trace_id", "q_seq", *mt.AT).agg(F.min("q_end").alias("q_end"))
    q = stored(q, "ends")
    at = p.select("case_id", "trace_id", "seq", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    ids = ["case_id", "q_trace_id", "q_seq", "trace_id"]
    cand = mt.nearest_per_trace(q.drop("q_end"), p, r).select(*ids, "seq", "dist")
    cand = stored(cand.join(q, ids[:3]).join(at, ["case_id", "trace_id", "seq"]), "candidates")
    back = cand.select("case_id", F.struct("q_trace_id", "q_seq", F.col("trace_id").alias("t")).alias("q_id"), F.col("q_trace_id").alias("trace_id"), *[F.col(f"b{c}").alias(f"q{c}") for c in "xyz"])
    own = mt.nearest_in_trace(back, p, r).select("case_id", "q_id.q_trace_id", "q_id.q_seq", F.col("q_id.t").alias("trace_id"), F.col("seq").alias("own"))
    cand = stored(cand.join(own, ids).where("own = q_seq"), "links")
    link = cand.select(*ids, *[F.col(f"q{c}").alias(f"a{c}") for c in "xyz"], *[f"b{c}" for c in "xyz"])
    cost = ed.link_costs(mt.sample_sets(path_sets(link), voxels, "score", ids, "k"), ids).select(*ids, "loss")
    name = lambda t, s: F.concat_ws(":", t, s)
    # Both sides go by position, so that an end is the same as a start and as a target.
    c = cand.join(cost, ids).select(
        "case_id", name("q_trace_id", "q_seq").alias("a"), name("trace_id", "seq").alias("b"), name("q_trace_id", "q_end").alias("end"),
        F.round(F.col("loss") - 0.5 / r * (r - F.col("dist")), 6).alias("loss"),
    )
    c = stored(c, "losses")
    done = gr.mutual_links(c.drop("end"), below)
    return done.join(c.select("case_id", "a", "b", "end"), ["case_id", "a", "b"]).select("case_id", "loss", F.col("end").alias("a"), "b")


def apply_links(points: DataFrame, merges: DataFrame, branches: DataFrame, gap: float | None = 1.0) -> DataFrame:
    """Traces with links carried out: ends get the points they branch from, linked ends make one trace.

    ``merges(case_id, ta, ea, tb, eb)``: each end in one row at most; ``branches(case_id, trace_id, end,
    tx, ty, tz, t_rad)`` on other ends.  Repeated points go, the result is resampled at ``gap``.
    """
    p = stored(ed.branch_to(points.select(*BASE), branches), "branched")
    p = stored(gr.merge_at_ends(p, merges).select(*BASE), "merged")
    p = stored(tr.remove_duplicate_points(p).select(*BASE), "distinct")
    return p if gap is None else tr.resample(p, gap)


def _targets(links: DataFrame, points: DataFrame) -> DataFrame:
    """``links(case_id, ta, ea, tb, seq)`` with the target's position and which end of its trace it is (``eb``, NULL inside)."""
    last = points.groupBy("case_id", "trace_id").agg(F.max("seq").alias("_last"))
    at = points.join(last, ["case_id", "trace_id"]).select(
        "case_id", F.col("trace_id").alias("tb"), "seq", F.when(F.col("seq") == 0, 0).when(F.col("seq") == F.col("_last"), 1).alias("eb"),
        *[F.col(c).alias(f"t{c}") for c in "xyz"], F.col("rad").alias("t_rad"),
    )
    return stored(links.join(at, ["case_id", "tb", "seq"]), "targets")


def connect_ends(points: DataFrame, voxels: DataFrame, r: float = 30.0, below: float = -0.3, gap: float | None = 1.0) -> DataFrame:
    """Accepted links of trace ends (``greedy_links``) carried out: ends that meet ends are merged, others branch."""
    name = lambda c, i: F.split(F.col(c), ":")[i].cast("bigint")
    links = greedy_links(points, voxels, r, below).select("case_id", name("a", 0).alias("ta"), name("a", 1).cast("int").alias("ea"), name("b", 0).alias("tb"), name("b", 1).alias("seq"))
    to = _targets(links, points)
    branches = to.where("eb is null").select("case_id", F.col("ta").alias("trace_id"), F.col("ea").alias("end"), "tx", "ty", "tz", "t_rad")
    return apply_links(points, to.where("eb is not null").select("case_id", "ta", "ea", "tb", "eb"), branches, gap)


def join_near_ends(points: DataFrame, r: float = 10.0, values: DataFrame | None = None, gate: float = 0.5, gap: float | None = 1.0) -> DataFrame:
    """Every end joined to the nearest point of another trace within ``r``.

    An end near an end is merged with it, nearest pairs first, each end once; an end near the
    inside of a trace branches from it if that lies ahead of the trace.  With ``values`` a link's mean cost must stay below ``gate``.
    """
    p = stored(points.select(*BASE), "traces")
    near = gr.end_links(p, r, values, gate).select("case_id", F.col("q_trace_id").alias("ta"), F.col("q_end").alias("ea"), F.col("trace_id").alias("tb"), "seq", "dist")
    to = _targets(near, p)
    name = lambda t, e: F.concat_ws(":", t, e)
    ask = to.where("eb is not null").select("case_id", name("ta", "ea").alias("a"), name("tb", "eb").alias("b"), (F.col("dist") - r).alias("loss"))
    # Two ends that name each other are one link.
    ask = ask.groupBy("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("loss").alias("loss"))
    part = lambda c, i, kind: F.split(F.col(c), ":")[i].cast(kind)
    merges = stored(gr.mutual_links(ask, 0.0).select("case_id", part("a", 0, "bigint").alias("ta"), part("a", 1, "int").alias("ea"), part("b", 0, "bigint").alias("tb"), part("b", 1, "int").alias("eb")), "merges")
    e = mt.ends(p)
    own = e.select("case_id", F.col("trace_id").alias("ta"), F.col("end").alias("ea"), *[F.col(c).alias(f"e{c}") for c in "xyz"])
    other = e.select("case_id", F.col("trace_id").alias("ta"), (1 - F.col("end")).alias("ea"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    ahead = sum((F.col(f"t{c}") - F.col(f"e{c}")) * (F.col(f"e{c}") - F.col(f"o{c}")) for c in "xyz")
    body = to.where("eb is null").join(own, ["case_id", "ta", "ea"]).join(other, ["case_id", "ta", "ea"]).where(ahead > 0)
    return apply_links(p, merges, body.select("case_id", F.col("ta").alias("trace_id"), F.col("ea").alias("end"), "tx", "ty", "tz", "t_rad"), gap)
