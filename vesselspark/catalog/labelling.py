"""Rule stages of anatomical labelling, run on the simplified trace graph.

Probabilities are derived from the node and edge numbers: the stages only need some table.
"""

from pyspark.sql import functions as F

from ..functions.lookups import end_rules, sql_values
from ..operators import graph as gr, labelling as lb
from ..session import stored
from . import query
from .features import rounded
from .graphs import SIMPLE


def inputs(p):
    nodes, edges = gr.simplified_graph(p)
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    edges = edges.withColumn("vestype", ((F.col("src") % 3 + F.col("dst") % 3) % 3 + 1).cast("int"))
    node = nodes.withColumn("h", F.pmod(F.col("node"), F.lit(1009)))
    prob = node.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(22)))).select("case_id", "node", "cls", ((F.col("h") * (F.col("cls") + 1) * 7919) % 1013 / 1013.0).alias("p"))
    return nodes, edges, stored(prob, "prob")


LAB = f"""{SIMPLE}, ee AS (SELECT *, CAST((src % 3 + dst % 3) % 3 + 1 AS INTEGER) AS vestype FROM sm), ns AS (SELECT DISTINCT case_id, node FROM dg WHERE deg <> 2),
pb AS (SELECT case_id, node, cls, (node % 1009) * (cls + 1) * 7919 % 1013 / 1013.0::DOUBLE AS p FROM ns, generate_series(0, 22) g(cls)),
bc AS (SELECT case_id, node, arg_max(cls, p - cls * 1e-12) AS cls, max(p) AS p FROM pb GROUP BY ALL),
it AS (SELECT case_id, node, list_sort(list(vestype)) AS types FROM (SELECT case_id, src AS node, vestype FROM ee UNION ALL SELECT case_id, dst, vestype FROM ee) q GROUP BY ALL),
mt(cls, types) AS (VALUES {', '.join(f'({t}, {sorted(v)})' for t, v in lb.MEETING.items())}),
ft AS (SELECT bc.case_id, bc.node, bc.cls, bc.p FROM bc JOIN it ON it.case_id = bc.case_id AND it.node = bc.node JOIN mt ON mt.cls = bc.cls AND mt.types = it.types)"""


@query("fitting_nodes", ["fx_points"], f"WITH {LAB} SELECT case_id, node, CAST(cls AS BIGINT) AS cls, round(p, 9) AS p FROM ft")
def fitting_nodes(p):
    _, edges, prob = inputs(p)
    return rounded(lb.fitting_nodes(prob, edges), ["p"], 9).withColumn("cls", F.col("cls").cast("bigint"))


@query("confident_nodes", ["fx_points"], f"WITH {LAB} SELECT case_id, CAST(cls AS BIGINT) AS node_type, arg_max(node, (p, node)) AS node, round(max(p), 9) AS p FROM ft WHERE cls NOT IN (9, 10, 11, 12, 15, 16, 21, 22) GROUP BY case_id, cls")
def confident_nodes(p):
    _, edges, prob = inputs(p)
    return rounded(lb.confident_nodes(prob, edges), ["p"], 9).withColumn("node_type", F.col("node_type").cast("bigint"))


@query("fit_counts", ["fx_points"], f"WITH {LAB} SELECT case_id, count(*) FILTER (WHERE node % 5 <> 0) AS fit, count(*) FILTER (WHERE node % 5 <> 0 AND node % 5 <> cls) AS wrong FROM ft GROUP BY case_id")
def fit_counts(p):
    nodes, edges, prob = inputs(p)
    truth = nodes.select("case_id", "node", (F.col("node") % 5).alias("true"))
    return lb.fit_counts(lb.fitting_nodes(prob, edges), truth)


@query("repair_ends", ["fx_swc"], f"""WITH rules(a, b, v) AS (VALUES {sql_values(end_rules())}), us(v, a, b) AS (VALUES {sql_values((v, a, b) for v, (a, b) in lb.USUAL_ENDS.items())}),
e AS (SELECT case_id, id, type AS a, CAST(1 + (type + id) % 22 AS INTEGER) AS b, CAST(1 + id % 24 AS INTEGER) AS vestype FROM fx_swc WHERE type <> 0)
SELECT e.case_id, id, e.vestype, CASE WHEN rules.v IS DISTINCT FROM e.vestype THEN us.a ELSE e.a END AS start_type, CASE WHEN rules.v IS DISTINCT FROM e.vestype THEN us.b ELSE e.b END AS end_type
FROM e LEFT JOIN rules ON rules.a = e.a AND rules.b = e.b LEFT JOIN us ON us.v = e.vestype""")
def repair_ends(nodes):
    v = nodes.where("type <> 0").select(
        "case_id", "id", F.col("type").cast("int").alias("start_type"), (1 + (F.col("type") + F.col("id")) % 22).cast("int").alias("end_type"), (1 + F.col("id") % 24).cast("int").alias("vestype")
    )
    return lb.repair_ends(v)


@query("node_features", ["fx_points"])
def node_features(p):
    from ..functions import geometry as g
    from ..operators.traces import shifted

    nodes, _, _ = inputs(p)
    near = shifted(gr.with_nodes(p), [1]).where("n1_x is not null")
    d = near.select("case_id", "node", g.best_direction(g.sub(g.vec("n1_x", "n1_y", "n1_z"), g.vec("x", "y", "z"))).alias("dir")).where("dir is not null")
    out = lb.node_features(nodes, d, 0.5, (0.1, 0.1, 0.1))
    return out.withColumn("features", F.transform("features", lambda v: F.round(v, 6)))


_staged = {}


def _typed(p):
    """Every stage in order (once per session): confident nodes, centres, branches, swap."""
    key = (p.sparkSession.sparkContext.applicationId, p.semanticHash())
    if key not in _staged:
        _staged[key] = _stages(p)
    return _staged[key]


def _stages(p):
    nodes, edges, prob = inputs(p)
    typed = stored(lb.confident_nodes(prob, edges).select("case_id", "node_type", "node"), "typed")
    lengths = stored(lb.branch_lengths(lb.hop_paths(edges, typed.select("case_id", F.col("node").alias("source"))), typed), "lengths")
    for centre in lb.CENTRES:
        typed = stored(lb.decide_centre(centre, typed, nodes, edges, prob, lengths), "typed")
        typed = stored(lb.assign_branches(centre, typed, nodes, edges, prob, lengths), "typed")
    return nodes, edges, stored(lb.swap_left_right(typed, nodes), "typed"), lengths


@query("branch_lengths", ["fx_points"])
def branch_lengths(p):
    _, edges, prob = inputs(p)
    typed = stored(lb.best_class(prob).select("case_id", F.col("cls").alias("node_type"), "node").groupBy("case_id", "node_type").agg(F.min("node").alias("node")), "typed")
    return rounded(lb.branch_lengths(lb.hop_paths(edges, typed.select("case_id", F.col("node").alias("source"))), typed), ["mean", "std"])


@query("typed_nodes", ["fx_points"])
def typed_nodes(p):
    return _typed(p)[2]


@query("labelled_vessels", ["fx_points"])
def labelled_vessels(p):
    nodes, edges, typed, lengths = _typed(p)
    paths = stored(lb.hop_paths(edges, typed.select("case_id", F.col("node").alias("source"))), "paths")
    near = lb.fill_paths(typed, paths)
    far = lb.fill_distal(typed, edges, nodes, paths).join(near, ["case_id", "src", "dst"], "left_anti")
    return rounded(lb.extract_vessels(near.unionByName(far), edges, p), ["x", "y", "z", "rad"])


@query("path_checks", ["fx_points"])
def path_checks(p):
    _, edges, typed, lengths = _typed(p)
    paths = lb.hop_paths(edges, typed.select("case_id", F.col("node").alias("source")))
    return lb.path_checks(typed, paths, lengths)
