"""Streams, clustering and multi-step cohort queries."""

from pyspark.sql import functions as F

from ..streaming import metrics as sm
from . import ORACLE, QUERIES, query
from .features import TOTAL_TOT, TRACES, rounded


def _stream(name, build, keys, sql, digits=6):
    def run(spark, sf_dir):
        out = sm.run_available(build(sm.metric_stream(spark, sf_dir)), keys)
        return rounded(out, [c for c in ("value", "best") if c in out.columns], digits)

    QUERIES[name] = run
    ORACLE[name] = sql


ROWS = "m AS (SELECT CAST(ts AS DATE) AS epoch, event_id, CASE WHEN event_type IN ('click', 'view') THEN concat('seg_', event_type) ELSE event_type END AS name, value, 1 + event_id % 3 AS n FROM events)"
_stream("stream_metrics", sm.running_epoch_metrics, ["epoch", "name"], f"""WITH {ROWS}
SELECT CAST(epoch AS VARCHAR) AS epoch, name, round(CASE WHEN name LIKE 'seg!_%' ESCAPE '!' THEN sum(value) ELSE sum(value * n) / sum(n) END, 6) AS value FROM m GROUP BY epoch, name""")
_stream("stream_best", sm.best_so_far, ["name"], f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value DESC, event_id) AS k FROM m)
SELECT name, round(value, 6) AS best, event_id AS case_id FROM r WHERE k = 1""")


@query("kmeans_select", ["fx_points"])
def kmeans_select(p):
    from ..operators.selection import select_traces

    return select_traces(p)


# Breadth first from the lowest trace of every case; the samples are every fifth point and the last.
@query("grown_traces", ["fx_points"], """WITH l AS (SELECT case_id, trace_id, max(seq) AS last FROM fx_points GROUP BY ALL),
e AS MATERIALIZED (SELECT DISTINCT q.case_id, q.trace_id AS a, t.trace_id AS b FROM fx_points q JOIN l USING (case_id, trace_id) JOIN fx_points t ON t.case_id = q.case_id AND t.trace_id <> q.trace_id
  WHERE (q.seq % 5 = 0 OR q.seq = last) AND sqrt((q.x-t.x)*(q.x-t.x) + (q.y-t.y)*(q.y-t.y) + (q.z-t.z)*(q.z-t.z)) < 0.9),
g(case_id, trace_id, round) USING KEY (case_id, trace_id) AS (SELECT case_id, min(trace_id), 0 FROM fx_points GROUP BY case_id UNION
  SELECT e.case_id, e.a, min(g.round) + 1 FROM g JOIN e ON e.case_id = g.case_id AND e.b = g.trace_id LEFT JOIN recurring.g r ON r.case_id = e.case_id AND r.trace_id = e.a WHERE r.round IS NULL GROUP BY e.case_id, e.a)
SELECT case_id, trace_id, CAST(round AS BIGINT) AS round FROM g""")
def grown_traces(p):
    from ..operators.selection import grown

    start = p.groupBy("case_id").agg(F.min("trace_id").alias("trace_id"))
    return grown(p, start, 0.9).select("case_id", "trace_id", F.col("round").cast("bigint").alias("round"))


@query("tree", ["fx_points", "fx_voxels"])
def tree(p, v):
    from ..operators.compositions import traces_to_tree

    return traces_to_tree(p.select("case_id", "trace_id", "seq", "x", "y", "z", "rad"), v)


@query("mask_to_traces", ["fx_voxels"])
def mask_to_traces(v):
    from ..operators.compositions import mask_to_traces as build

    return build(v, v.where("gt > 0 and intensity >= 42"))


@query("case_scores", ["fx_voxels"], """WITH t AS (SELECT *, intensity > 0.5 * max(intensity) OVER (PARTITION BY case_id) AS m FROM fx_voxels), c AS (SELECT case_id, 2.0::DOUBLE * sum((gt > 0)::INT * m::INT) / sum((gt > 0)::INT + m::INT) AS dsc, avg(abs(score - (gt > 0)::INT)) AS mad FROM t GROUP BY case_id)
SELECT CAST(case_id AS VARCHAR) AS case_name, round(dsc, 9) AS dsc, round(mad, 9) AS mad FROM c UNION ALL SELECT 'mean', round(avg(dsc), 9), round(avg(mad), 9) FROM c""")
def case_scores(v):
    from ..operators import evaluation as ev

    d = ev.dice_of_ratio(v, "intensity").join(ev.agreement(v).select("case_id", F.col("mean_abs").alias("mad")), "case_id")
    rows = d.select(F.col("case_id").cast("string").alias("case_name"), "dsc", "mad")
    return rounded(rows.unionByName(d.select(F.lit("mean").alias("case_name"), "dsc", "mad").groupBy("case_name").agg(F.avg("dsc").alias("dsc"), F.avg("mad").alias("mad"))), ["dsc", "mad"], 9)


@query("main_tree_without_loops", ["fx_points"])
def main_tree_without_loops(p):
    from ..operators.compositions import main_tree_without_loops as build

    return build(p.select("case_id", "trace_id", "seq", "x", "y", "z", "rad"), 0.6, 2, 5.0)


@query("add_lower_threshold", ["fx_points", "fx_pred_points"])
def add_lower_threshold(p, pred):
    from ..operators.compositions import add_lower_threshold as build

    return build(p, pred)


@query("labelled_graph", ["fx_points", "fx_landmarks"])
def labelled_graph(p, lm):
    from ..operators.compositions import labelled_graph as build

    nodes, edges = build(p, lm)
    n = nodes.select("case_id", F.lit("node").alias("part"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("node_type").cast("bigint").alias("kind"))
    return n.unionByName(edges.select("case_id", F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("vestype").cast("bigint").alias("kind")))


@query("labelled_candidates", ["fx_pred_points", "fx_points"])
def labelled_candidates(pred, p):
    from ..operators.graph import labelled_candidates as build

    return build(pred, p)


@query("align_masks", ["fx_voxels"], "SELECT case_id, x, y, z, gt, pred FROM fx_voxels WHERE gt > 0 OR pred > 0")
def align_masks(v):
    from ..operators.evaluation import align

    at = ["case_id", "x", "y", "z"]
    return align(v.where("gt > 0").select(*at, F.col("gt").alias("label")), v.where("pred > 0").select(*at, F.col("pred").alias("label")))


@query("unambiguous_pairs", ["fx_points"], """WITH pr AS (SELECT a.case_id, a.trace_id AS a, b.trace_id AS b FROM (SELECT case_id, trace_id, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(z, seq) AS z FROM fx_points GROUP BY ALL) a
  JOIN fx_points b ON b.case_id = a.case_id AND b.seq = 0 AND b.trace_id <> a.trace_id AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3 AND abs(a.z - b.z) < 3 AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) < 3),
t AS (SELECT case_id, t FROM (SELECT case_id, a AS t FROM pr UNION ALL SELECT case_id, b FROM pr) q GROUP BY ALL HAVING count(*) > 1)
SELECT * FROM pr WHERE (case_id, a) NOT IN (SELECT (case_id, t) FROM t) AND (case_id, b) NOT IN (SELECT (case_id, t) FROM t)""")
def unambiguous_pairs(p):
    from ..operators import graph as gr, matching as mt
    from ..plans.grid import near_pairs

    e = mt.ends(p)
    q = mt.as_queries(e.where("end = 1"))
    heads = e.where("end = 0").select("case_id", "trace_id", "x", "y", "z")
    near = near_pairs(q, heads, 3.0, mt.AT, where=F.col("q_trace_id") != F.col("trace_id"))
    return gr.unambiguous(near.select("case_id", F.col("q_trace_id").alias("a"), F.col("trace_id").alias("b")))


@query("named_features", ["fx_points"], f"""WITH {TRACES} SELECT case_id, count(*) AS "Branches", round(sum(length) * 0.5, 6) AS "Length", round(sum(volume) * 0.125, 6) AS "Volume", round({TOTAL_TOT}, 6) AS "Tortuosity" FROM tf GROUP BY case_id""")
def named_features(p):
    from ..functions.registry import case_table
    from ..operators.traces import trace_features

    return rounded(case_table(trace_features(p), ["Branches", "Length", "Volume", "Tortuosity"], res=0.5), ["Length", "Volume", "Tortuosity"])
