"""Rule stages that turn label probabilities on a simplified graph into typed nodes and edges.

Tables: nodes(case_id, node, x, y, z, rad, deg), edges(case_id, src, dst, dist), node
probabilities(case_id, node, cls, p), edge predictions(case_id, src, dst, vestype),
typed nodes(case_id, node_type, node).  Every stage handles all cases in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.lookups import end_rules, end_rule_table
from ..plans.casework import by_size, in_cases, walks
from ..plans.graphloop import fewest_hops
from ..session import stored
from .traces import POS

# Vessel types that meet at each landmark type.
MEETING = {
    1: [1], 2: [2], 3: [1, 3, 7], 4: [2, 4, 8], 5: [7, 9, 11], 6: [8, 10, 11], 7: [3, 5, 5], 8: [4, 6, 6],
    9: [1, 1, 23], 10: [2, 2, 24], 11: [23], 12: [24], 15: [14], 16: [15], 17: [14, 15, 16], 18: [16, 17, 18],
    19: [17, 19, 21], 20: [18, 20, 22], 21: [1, 1, 21], 22: [2, 2, 22],
}
# Landmark types around each centre.
CENTRES = {3: [1, 5, 7], 4: [2, 6, 8], 18: [17, 19, 20]}
# Types that are not taken as confident.
NOT_KEY = [9, 10, 11, 12, 15, 16, 21, 22]
# Vessel type of the path between two landmark types.
PATH_TYPES = {11: (5, 6), 21: (19, 21), 22: (20, 22), 23: (9, 11), 24: (10, 12), 14: (15, 17), 15: (16, 17)}
# Distal fill, "from through vessel".
DISTAL = [(3, 7, 5), (4, 8, 6), (3, 5, 9), (4, 6, 10), (18, 19, 19), (18, 20, 20)]
# Usual end types of a vessel type.
USUAL_ENDS = {
    1: (1, 3), 2: (2, 4), 3: (3, 7), 4: (4, 8), 5: (7, 13), 6: (8, 14), 7: (3, 5), 8: (4, 6), 9: (5, 23), 10: (6, 24), 11: (5, 6), 12: (13, 25),
    13: (14, 26), 14: (15, 17), 15: (16, 17), 16: (17, 18), 17: (18, 19), 18: (18, 20), 19: (19, 27), 20: (20, 28), 21: (19, 21), 22: (20, 22), 23: (9, 11), 24: (10, 12),
}
# Fixed value: probability below which a centre is left open.
LEAST_PROBABILITY = 1e-10

VESSEL_OF = {(a, b): v for a, b, v in end_rules()}


def node_features(nodes: DataFrame, directions: DataFrame, res: float, offset: Sequence[float]) -> DataFrame:
    """Scaled position, radius, degree and the 26 direction counts of a node as one array."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.coalesce(F.element_at("_m", i.cast("int")), F.lit(0)))
    per = directions.groupBy("case_id", "node", "dir").agg(F.count("*").alias("n"))
    m = per.groupBy("case_id", "node").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dir").cast("int"), F.col("n").cast("int")))).alias("_m"))  # at most 26 entries
    at = [F.col(c) * res / 200 - o for c, o in zip(POS, offset)]
    full = nodes.join(m, ["case_id", "node"], "left").withColumn("_m", F.coalesce("_m", F.create_map().cast("map<int,int>")))
    return full.select("case_id", "node", F.concat(F.array(*at, F.col("rad") * res, F.col("deg").cast("double")), counts.cast("array<double>")).alias("features"))


def best_class(prob: DataFrame, keys: Sequence[str] = ("case_id", "node")) -> DataFrame:
    """Most probable class of each node; equal probabilities go to the lower class."""
    m = prob.groupBy(*keys).agg(F.min(F.struct((-F.col("p")).alias("p"), "cls")).alias("m"))
    return m.select(*keys, F.col("m.cls").alias("cls"), (-F.col("m.p")).alias("p"))


def incident_types(edges: DataFrame) -> DataFrame:
    """Sorted (type, count) list of the predicted edges at each node; at most one entry per type."""
    both = edges.select("case_id", F.col("src").alias("node"), "vestype").unionByName(edges.select("case_id", F.col("dst").alias("node"), "vestype"))
    n = both.groupBy("case_id", "node", "vestype").agg(F.count("*").alias("n"))
    return n.groupBy("case_id", "node").agg(F.sort_array(F.collect_list(F.struct(F.col("vestype").cast("int").alias("t"), F.col("n").cast("int").alias("n")))).alias("types"))


def _meeting_table(spark: SparkSession) -> DataFrame:
    rows = [(t, [(v, vs.count(v)) for v in sorted(set(vs))]) for t, vs in MEETING.items()]
    return spark.createDataFrame(rows, "cls int, types array<struct<t:int,n:int>>")


def fitting_nodes(prob: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose incident edge types are those of their predicted type."""
    fit = best_class(prob).join(incident_types(edges), ["case_id", "node"])
    return fit.join(F.broadcast(_meeting_table(prob.sparkSession)), ["cls", "types"]).select("case_id", "node", "cls", "p")


def confident_nodes(prob: DataFrame, edges: DataFrame) -> DataFrame:
    """One node per type among the fitting ones: highest probability, then highest node."""
    ok = fitting_nodes(prob, edges).where(~F.col("cls").isin(NOT_KEY))
    return ok.groupBy("case_id", F.col("cls").alias("node_type")).agg(F.max(F.struct("p", "node")).alias("m")).select("case_id", "node_type", F.col("m.node").alias("node"), F.col("m.p").alias("p"))


def fit_counts(fitting: DataFrame, truth: DataFrame) -> DataFrame:
    """How many fitting nodes have a true type, and how many of those differ from it."""
    t = fitting.join(truth, ["case_id", "node"])
    return t.groupBy("case_id").agg(F.count_if(F.col("true") != 0).alias("fit"), F.count_if((F.col("true") != 0) & (F.col("true") != F.col("cls"))).alias("wrong"))


def hop_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths of fewest edges from each source and their summed ``dist``: (case_id, source, node, path, dist)."""
    p = stored(fewest_hops(edges, sources).select("case_id", "source", "node", "path"), "hops")
    step = p.where("size(path) > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("path") - 1)))
    step = step.withColumns({"a": F.element_at("path", F.col("i")), "b": F.element_at("path", F.col("i") + 1)})
    e = edges.select("case_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.col("dist").alias("d"))
    ln = step.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(e, ["case_id", "lo", "hi"]).groupBy("case_id", "source", "node").agg(F.sum("d").alias("dist"))
    return p.join(ln, ["case_id", "source", "node"], "left").withColumn("dist", F.coalesce("dist", F.lit(0.0)))


def branch_lengths(paths: DataFrame, typed: DataFrame) -> DataFrame:
    """Mean and deviation of the path length per vessel type over all cases."""
    pairs = [(a, b, VESSEL_OF[(a, b)]) for a, bs in CENTRES.items() for b in bs] + [(a, b, v) for v, (a, b) in PATH_TYPES.items()]
    t = F.broadcast(typed.sparkSession.createDataFrame(pairs, "t1 int, t2 int, vestype int"))
    a = typed.select("case_id", F.col("node_type").alias("t1"), F.col("node").alias("source"))
    b = typed.select("case_id", F.col("node_type").alias("t2"), "node")
    w = a.join(t, "t1").join(b, ["case_id", "t2"]).join(paths, ["case_id", "source", "node"])
    return w.groupBy("vestype").agg(F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"), F.count("*").alias("n"))


def reachable(edges: DataFrame, degree: DataFrame, starts: DataFrame, closed: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Nodes met from a start without entering closed nodes, going on only through degree 3 and more.

    ``starts(case_id, q, root, node)``, ``closed(case_id, q, node)``.  With
    ``gates(case_id, root, node, ok)`` the walk stops behind nodes that are not ok.
    Returns (case_id, q, root, prev, node) with the start itself.
    """
    both = edges.select("case_id", "src", "dst").unionByName(edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.join(degree.select("case_id", F.col("node").alias("dst"), "deg"), ["case_id", "dst"])
    # Rows of one shape, so that a case that fits into a task is walked there.
    kind = dict(starts.dtypes)["q"]
    empty = {"q": kind, "u": "bigint", "v": "bigint", "deg": "bigint", "ok": "boolean"}

    def rows(df, what, **cols):
        full = [F.col(cols[c]).cast(t).alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in empty.items()]
        return df.select("case_id", F.lit(what).alias("what"), *full)

    asked = stored(starts.select("case_id", "q", "root", "node"), "starts")
    every = rows(both, 0, u="src", v="dst", deg="deg").unionByName(rows(asked, 1, q="q", u="root", v="node")).unionByName(rows(closed.select("case_id", "q", "node").distinct(), 2, q="q", v="node"))
    if gates is not None:
        every = every.unionByName(rows(gates, 3, u="root", v="node", ok="ok"))
    every = stored(every.join(asked.select("case_id").distinct(), "case_id", "left_semi"), "walks")
    small, large = by_size(every)
    found = in_cases(small, walks, f"q {kind}, root bigint, prev bigint, node bigint")
    if large is None:
        return found
    rest = every.join(large, "case_id", "left_semi")
    part = lambda what, **cols: rest.where(F.col("what") == what).select("case_id", *[F.col(c).alias(n) for n, c in cols.items()])
    gates = None if gates is None else part(3, root="u", node="v", ok="ok")
    return found.unionByName(_walk_rounds(part(0, src="u", dst="v", deg="deg"), part(1, q="q", root="u", node="v"), part(2, q="q", node="v"), gates))


def _walk_rounds(arcs: DataFrame, starts: DataFrame, closed: DataFrame, gates: DataFrame | None) -> DataFrame:
    """``reachable`` in rounds, over ``arcs(case_id, src, dst, deg)``."""
    both = stored(arcs, "arcs")
    front = stored(starts.select("case_id", "q", "root", F.lit(None).cast("bigint").alias("prev"), "node"), "front")
    seen, found = stored(closed.select("case_id", "q", "node").unionByName(front.select("case_id", "q", "node")).distinct(), "seen"), front
    while True:  # ends when no unseen node is met
        nxt = front.join(both, (front["case_id"] == both["case_id"]) & (front["node"] == both["src"])).select(front["case_id"], "q", "root", F.col("src").alias("prev"), F.col("dst").alias("node"), "deg")
        nxt = nxt.join(seen, ["case_id", "q", "node"], "left_anti").groupBy("case_id", "q", "root", "node", "deg").agg(F.min("prev").alias("prev"))
        nxt = stored(nxt, "met")
        if not nxt.limit(1).count():
            break
        found = found.unionByName(nxt.select(*found.columns))
        go = nxt.where("deg >= 3")
        if gates is not None:
            go = go.join(gates, ["case_id", "root", "node"], "left").where("coalesce(ok, true)")
        front = stored(go.select(*found.columns), "front")
        seen = stored(seen.unionByName(nxt.select("case_id", "q", "node")), "seen")
    return found


def best_within(reach: DataFrame, nodes: DataFrame, prob: DataFrame, wanted: DataFrame) -> DataFrame:
    """Best node per query among those reached: ``wanted(case_id, q, cls, want_deg, start)``.

    The start always counts; others need the wanted degree (any if NULL).
    """
    w = reach.join(wanted, ["case_id", "q"]).join(nodes.select("case_id", "node", "deg"), ["case_id", "node"])
    w = w.where(F.col("want_deg").isNull() | (F.col("deg") == F.col("want_deg")) | (F.col("node") == F.col("start")))
    w = w.join(prob, ["case_id", "node", "cls"])
    m = w.groupBy("case_id", "q", "cls").agg(F.max(F.struct("p", (-F.col("node")).alias("n"))).alias("m"))
    return m.select("case_id", "q", "cls", (-F.col("m.n")).alias("node"), F.col("m.p").alias("p"))


def decide_centre(centre: int, typed: DataFrame, nodes: DataFrame, edges: DataFrame, prob: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add the node of a centre type where it is missing.

    One confident neighbour: best node along its vessel; two: most probable node between
    them; three: the single node common to their paths; none (or no path): the most probable
    node of the case.  Probabilities below 1e-10 leave it open.
    """
    around = CENTRES[centre]
    typed = stored(typed, "typed")
    open_ = prob.select("case_id").distinct().join(typed.where(F.col("node_type") == centre).select("case_id"), "case_id", "left_anti")
    near = stored(typed.where(F.col("node_type").isin(around)).join(open_, "case_id", "left_semi"), "near")
    count = near.groupBy("case_id").agg(F.count("*").alias("k"))
    paths = stored(hop_paths(edges, near.select("case_id", F.col("node").alias("source"))), "paths")
    a = near.select("case_id", F.col("node_type").alias("t1"), F.col("node").alias("source"))
    b = near.select("case_id", F.col("node_type").alias("t2"), "node")
    pair = stored(a.join(b, "case_id").where("t1 < t2").join(paths, ["case_id", "source", "node"]).join(count, "case_id"), "pairs")
    inner = pair.where("k = 2").select("case_id", F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("node"))
    common = pair.where("k = 3").select("case_id", F.explode("path").alias("node")).groupBy("case_id", "node").agg(F.count("*").alias("c")).where("c = 3")
    only = common.groupBy("case_id").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("case_id", "node")
    own = prob.where(F.col("cls") == centre).select("case_id", "node", "p")
    two = inner.join(own, ["case_id", "node"]).groupBy("case_id").agg(F.max(F.struct("p", (-F.col("node")).alias("n"))).alias("m")).select("case_id", (-F.col("m.n")).alias("node"))
    # One neighbour: walk along the edge predicted as the vessel between the two types.
    rules = F.broadcast(typed.sparkSession.createDataFrame([(t, VESSEL_OF[(t, centre)]) for t in around], "t1 int, vestype int"))
    single = near.join(count.where("k = 1"), "case_id").select("case_id", F.col("node_type").alias("t1"), F.col("node").alias("root")).join(rules, "t1")
    arcs = edges.select("case_id", F.col("src").alias("root"), F.col("dst").alias("node"), "vestype").unionByName(edges.select("case_id", F.col("dst").alias("root"), F.col("src").alias("node"), "vestype"))
    start = single.join(arcs, ["case_id", "root", "vestype"]).groupBy("case_id", "root", "vestype").agg(F.min("node").alias("node")).withColumn("q", F.lit(0))
    start = stored(start, "start")
    gate = paths.join(start.select("case_id", F.col("root").alias("source"), "vestype"), ["case_id", "source"]).join(F.broadcast(lengths), "vestype", "left").select(
        "case_id", F.col("source").alias("root"), "node", (F.col("mean").isNull() | (F.col("dist") <= F.col("mean") + 2 * F.col("std"))).alias("ok")
    )
    others = typed.where(~F.col("node_type").isin(around)).select("case_id", "node").unionByName(start.select("case_id", F.col("root").alias("node")))
    met = reachable(edges, nodes, start.select("case_id", "q", "root", "node"), others.withColumn("q", F.lit(0)), gate)
    wanted = start.select("case_id", "q", F.lit(centre).alias("cls"), F.lit(3).alias("want_deg"), F.col("node").alias("start"))
    one = best_within(met, nodes, prob, wanted).select("case_id", "node")
    found = stored(one.unionByName(two).unionByName(only), "found")
    rest = open_.join(found, "case_id", "left_anti")
    top = own.join(rest, "case_id", "left_semi").groupBy("case_id").agg(F.max(F.struct("p", (-F.col("node")).alias("n"))).alias("m")).select("case_id", (-F.col("m.n")).alias("node"))
    new = found.unionByName(top).join(own, ["case_id", "node"]).where(F.col("p") >= LEAST_PROBABILITY)
    return typed.select("case_id", "node_type", "node").unionByName(new.select("case_id", F.lit(centre).alias("node_type"), "node"))


def assign_branches(centre: int, typed: DataFrame, nodes: DataFrame, edges: DataFrame, prob: DataFrame, lengths: DataFrame) -> DataFrame:
    """Give the missing types around a centre to its free neighbours: best permutation by summed probability.

    For each free neighbour and missing type the best node in that direction is found first
    (see ``best_within``); then at most 3 x 3 sums are compared.
    """
    around = CENTRES[centre]
    typed = stored(typed.select("case_id", "node_type", "node"), "typed")
    hub = stored(typed.where(F.col("node_type") == centre).select("case_id", F.col("node").alias("root")), "hub")
    known = typed.where(F.col("node_type").isin(around))
    paths = stored(hop_paths(edges, hub.select("case_id", F.col("root").alias("source"))), "paths")
    taken = paths.join(known, ["case_id", "node"]).select("case_id", F.try_element_at("path", F.lit(2)).alias("node"))
    arcs = edges.select("case_id", F.col("src").alias("root"), F.col("dst").alias("node")).unionByName(edges.select("case_id", F.col("dst").alias("root"), F.col("src").alias("node")))
    free = hub.join(arcs, ["case_id", "root"]).join(taken, ["case_id", "node"], "left_anti")
    kinds = typed.sparkSession.createDataFrame([(t, VESSEL_OF[(t, centre)], None if t == 17 else len(MEETING[t])) for t in around], "cls int, vestype int, want_deg int")
    miss = hub.select("case_id").crossJoin(F.broadcast(kinds)).join(known.select("case_id", F.col("node_type").alias("cls")), ["case_id", "cls"], "left_anti")  # 3 rows
    ask = stored(free.join(miss, "case_id").withColumn("q", F.concat_ws(":", "node", "cls")), "ask")
    gate = paths.select("case_id", F.col("source").alias("root"), "node", "dist")
    lim = ask.select("case_id", "q", "root", "vestype").join(F.broadcast(lengths), "vestype", "left")
    closed = ask.select("case_id", "q").join(typed.select("case_id", "node"), "case_id")
    met = reachable(edges, nodes, ask.select("case_id", "q", "root", "node"), closed)
    ok = met.join(gate, ["case_id", "root", "node"], "left").join(lim.select("case_id", "q", "mean", "std"), ["case_id", "q"])
    ok = ok.where("mean is null or dist is null or dist <= mean + 2 * std").select(*met.columns)
    best = best_within(ok, nodes, prob, ask.select("case_id", "q", "cls", "want_deg", F.col("node").alias("start")))
    best = best.join(ask.select("case_id", "q", F.col("node").alias("via")), ["case_id", "q"]).select("case_id", "cls", "via", "node", "p")
    best = stored(best, "best")
    # The centre of the rules has three branches: keep the free neighbours' best three per type.
    w = Window.partitionBy("case_id", "cls").orderBy(F.desc("p"), "via")
    opts = best.withColumn("_k", F.row_number().over(w)).where("_k <= 3").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("cls", "via", "node", "p"))).alias("o"))  # at most nine entries a case
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, e: a + e["p"])
    got = opts.select("case_id", F.array_max(F.transform(_choices(around), lambda s: F.struct(total(s).alias("t"), s.alias("s")))).alias("m"))
    top = got.select("case_id", F.explode("m.s").alias("e"))
    return typed.unionByName(top.select("case_id", F.col("e.cls").alias("node_type"), F.col("e.node").alias("node")))


def _choices(around: Sequence[int]):
    """All ways (27 at most) to take an entry of ``o`` for each type that has one, no two with the same neighbour."""
    of = lambda kind: F.filter("o", lambda e: e["cls"] == kind)
    free = lambda kind, s: F.filter(of(kind), lambda e: ~F.exists(s, lambda x: x["via"] == e["via"]))
    more = lambda kind, ways: F.flatten(F.transform(ways, lambda s: F.transform(free(kind, s), lambda e: F.concat(s, F.array(e)))))
    ways = F.array(F.slice("o", 1, 0))
    for kind in sorted(around):
        ways = F.when(F.size(of(kind)) == 0, ways).otherwise(more(kind, ways))
    return ways


def swap_left_right(typed: DataFrame, nodes: DataFrame, left: int = 19, right: int = 20) -> DataFrame:
    """Swap the two types of a case where the left node has the smaller x."""
    x = nodes.select("case_id", "node", "x")
    both = typed.where(F.col("node_type").isin(left, right)).join(x, ["case_id", "node"]).groupBy("case_id").agg(
        F.max(F.when(F.col("node_type") == left, F.col("x"))).alias("lx"), F.max(F.when(F.col("node_type") == right, F.col("x"))).alias("rx")
    )
    t = typed.join(both.where("lx < rx").select("case_id", F.lit(True).alias("_s")), "case_id", "left")
    turned = F.when(F.col("node_type") == left, right).when(F.col("node_type") == right, left).otherwise(F.col("node_type"))
    return t.withColumn("node_type", F.when(F.col("_s"), turned).otherwise(F.col("node_type"))).drop("_s")


def path_checks(typed: DataFrame, paths: DataFrame, lengths: DataFrame, k: float = 2.0) -> DataFrame:
    """Communicating, ophthalmic and vertebral vessels: do both ends have a path of a usual length?"""
    rules = F.broadcast(typed.sparkSession.createDataFrame([(v, a, b) for v, (a, b) in PATH_TYPES.items()], "vestype int, t1 int, t2 int"))
    a = typed.select("case_id", F.col("node_type").alias("t1"), F.col("node").alias("source"))
    b = typed.select("case_id", F.col("node_type").alias("t2"), "node")
    w = a.join(rules, "t1").join(b, ["case_id", "t2"]).join(paths.select("case_id", "source", "node", "dist"), ["case_id", "source", "node"], "left").join(F.broadcast(lengths), "vestype", "left")
    state = F.when(F.col("dist").isNull(), "no path").when(F.col("mean").isNotNull() & (F.abs(F.col("dist") - F.col("mean")) > k * F.col("std")), "length").otherwise("ok")
    return w.select("case_id", "vestype", "source", "node", state.alias("state"))


def fill_paths(typed: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges on the path between typed nodes get the vessel type of the pair: (case_id, src, dst, vestype).

    Paths between landmark pairs of a circle centre are filled whole; others only up to the
    first key node on the way.  Of several types the lowest is kept.
    """
    rows = [(a, b, VESSEL_OF[(a, b)], True) for a, bs in CENTRES.items() for b in bs] + [(a, b, v, False) for v, (a, b) in PATH_TYPES.items()]
    rules = F.broadcast(typed.sparkSession.createDataFrame(rows, "t1 int, t2 int, vestype int, whole boolean"))
    a = typed.select("case_id", F.col("node_type").alias("t1"), F.col("node").alias("source"))
    b = typed.select("case_id", F.col("node_type").alias("t2"), "node")
    p = a.join(rules, "t1").join(b, ["case_id", "t2"]).join(paths.select("case_id", "source", "node", "path"), ["case_id", "source", "node"]).where("size(path) > 1")
    step = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("path") - 1))).withColumns({"u": F.element_at("path", F.col("i")), "v": F.element_at("path", F.col("i") + 1)})
    key = typed.select("case_id", F.col("node").alias("u"), F.lit(1).alias("_key")).distinct()
    step = step.join(key, ["case_id", "u"], "left")
    stop = step.where("not whole and _key = 1 and u <> source").groupBy("case_id", "source", "node", "vestype").agg(F.min("i").alias("_stop"))
    ok = step.join(stop, ["case_id", "source", "node", "vestype"], "left").where("_stop is null or i < _stop")
    return ok.groupBy("case_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.min("vestype").alias("vestype"))


def fill_distal(typed: DataFrame, edges: DataFrame, degree: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges beyond a branch node, away from its centre and up to the next key nodes."""
    rules = F.broadcast(typed.sparkSession.createDataFrame(DISTAL, "t1 int, t2 int, vestype int"))
    a = typed.select("case_id", F.col("node_type").alias("t1"), F.col("node").alias("hub"))
    b = typed.select("case_id", F.col("node_type").alias("t2"), "node")
    p = a.join(rules, "t1").join(b, ["case_id", "t2"]).join(paths.select("case_id", F.col("source").alias("hub"), "node", "path"), ["case_id", "hub", "node"]).where("size(path) > 1")
    start = stored(p.select("case_id", F.col("vestype").alias("q"), F.col("node").alias("root"), "node", F.try_element_at("path", F.lit(-2)).alias("back")), "start")
    closed = start.select("case_id", "q", F.col("back").alias("node")).unionByName(start.select("case_id", "q").join(typed.select("case_id", "node"), "case_id"))
    met = reachable(edges, degree, start.select("case_id", "q", "root", "node"), closed)
    e = met.where("prev is not null").select("case_id", F.least("prev", "node").alias("src"), F.greatest("prev", "node").alias("dst"), F.col("q").alias("vestype"))
    return e.groupBy("case_id", "src", "dst").agg(F.min("vestype").alias("vestype"))


def repair_ends(vessels: DataFrame) -> DataFrame:
    """End types that do not belong to the vessel type are replaced by its usual pair."""
    spark = vessels.sparkSession
    usual = F.broadcast(spark.createDataFrame([(v, a, b) for v, (a, b) in USUAL_ENDS.items()], "vestype int, u1 int, u2 int"))
    rules = F.broadcast(end_rule_table(spark).withColumnRenamed("vestype", "_v"))
    w = vessels.join(rules, ["start_type", "end_type"], "left").join(usual, "vestype", "left")
    bad = ~F.col("_v").eqNullSafe(F.col("vestype")) & F.col("u1").isNotNull()
    return w.withColumns({"start_type": F.when(bad, F.col("u1")).otherwise(F.col("start_type")), "end_type": F.when(bad, F.col("u2")).otherwise(F.col("end_type"))}).drop("_v", "u1", "u2")


def extract_vessels(labelled: DataFrame, simple_edges: DataFrame, points: DataFrame, least: int = 3) -> DataFrame:
    """Points of every labelled edge along its chain; vessels of ``least`` points or fewer go."""
    e = labelled.select("case_id", "src", "dst", F.col("vestype").alias("label")).join(simple_edges.select("case_id", "src", "dst", "trace_id", "last_seq", "n"), ["case_id", "src", "dst"]).where(F.col("n") + 1 > least)
    w = points.join(e, ["case_id", "trace_id"]).where((F.col("seq") <= F.col("last_seq")) & (F.col("seq") >= F.col("last_seq") - F.col("n")))
    return w.select("case_id", "src", "dst", F.col("label").alias("vestype"), (F.col("seq") - F.col("last_seq") + F.col("n")).alias("seq"), *POS, "rad")

