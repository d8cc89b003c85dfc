"""Trace measures and case features."""

from pyspark.sql import functions as F

from ..functions.lookups import GROUPS, RING_BACK, RING_FRONT, sql_values
from ..operators import features as feat, traces as tr
from . import query

STEPS = """steps AS (
  SELECT *, sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) AS step FROM (
    SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(rad) OVER w AS prad
    FROM fx_points WINDOW w AS (PARTITION BY case_id, trace_id ORDER BY seq)))"""
TRACES = STEPS + """, raw AS (
  SELECT case_id, trace_id, min(vestype) AS vestype, count(*) AS np, coalesce(sum(step), 0) AS length,
    coalesce(sum(step * pi() * (rad*rad + prad*prad) / 2), 0) AS volume, avg(rad) AS mean_rad, min(rad) AS min_rad,
    min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
    avg(x) AS mean_x, avg(y) AS mean_y, avg(z) AS mean_z,
    sqrt(pow(arg_max(x, seq) - arg_min(x, seq), 2) + pow(arg_max(y, seq) - arg_min(y, seq), 2)
       + pow(arg_max(z, seq) - arg_min(z, seq), 2)) AS chord
  FROM steps GROUP BY case_id, trace_id), tf AS (
  SELECT *, CASE WHEN chord > 0 THEN length / chord END AS tortuosity,
    (max_x - min_x) * (max_y - min_y) * (max_z - min_z) AS box_volume FROM raw)"""


def rounded(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


MEASURES = ["length", "volume", "tortuosity", "mean_rad", "min_rad", "box_volume"] + [
    f"{a}_{c}" for a in ("min", "max", "mean") for c in "xyz"
]


@query("trace_features", ["fx_points"], f"WITH {TRACES} SELECT case_id, trace_id, vestype, np, "
       + ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES) + " FROM tf")
def trace_features(points):
    return rounded(tr.trace_features(points, carry=["vestype"]), MEASURES)


TOTAL_TOT = "CASE WHEN sum(length) = 0 THEN 1 ELSE coalesce(sum(tortuosity * length) / sum(length), 0) END"


@query("case_features", ["fx_points"], f"""WITH {TRACES} SELECT case_id, count(*) AS n_traces,
  CAST(sum(np) AS BIGINT) AS n_points, round(sum(length), 6) AS length, round(sum(volume), 6) AS volume,
  round({TOTAL_TOT}, 6) AS tortuosity FROM tf GROUP BY case_id""")
def case_features(points):
    return rounded(feat.case_features(tr.trace_features(points)), ["length", "volume", "tortuosity"])


GROUP_ROWS = sql_values([(g, v) for g, vs in GROUPS.items() for v in vs])


@query("group_features", ["fx_points"], f"""WITH {TRACES}, members(grp, v) AS (VALUES {GROUP_ROWS})
SELECT case_id, grp, count(*) AS n_traces, round(sum(length), 6) AS length, round(sum(volume), 6) AS volume,
  round(coalesce(avg(tortuosity), 0), 6) AS tortuosity FROM tf JOIN members ON vestype = v GROUP BY case_id, grp""")
def group_features(points):
    return rounded(
        feat.group_features(tr.trace_features(points, carry=["vestype"])), ["length", "volume", "tortuosity"]
    )


def _pivot_sql(res):
    cols = []
    for grp, vs in {None: None, **GROUPS}.items():
        where = "" if vs is None else f" FILTER (WHERE vestype IN ({', '.join(map(str, vs))}))"
        head = "" if grp is None else f"{grp}_"
        tot = TOTAL_TOT if grp is None else f"coalesce(avg(tortuosity){where}, 0)"
        cols += [
            f"count(*){where} AS {head}artery_number",
            f"round(coalesce(sum(length){where}, 0) * {res}, 6) AS {head}length",
            f"round(coalesce(sum(volume){where}, 0) * {res ** 3!r}, 6) AS {head}volume",
            f"round({tot}, 6) AS {head}tortuosity",
        ]
    return f"WITH {TRACES} SELECT case_id, {', '.join(cols)} FROM tf GROUP BY case_id"


@query("feature_pivot", ["fx_points"], _pivot_sql(0.5))
def feature_pivot(points):
    out = feat.feature_pivot(tr.trace_features(points, carry=["vestype"]), res=0.5)
    return rounded(out, [c for c in out.columns if c != "case_id" and "number" not in c])


def _ring_sql(res):
    flags = []
    for v, name in (RING_FRONT | RING_BACK).items():
        cond = {11: f" AND min_rad * {res} * 2 > 1", 21: f" AND mean_rad * {res} * 2 > 1", 22: f" AND mean_rad * {res} * 2 > 1"}.get(v, "")
        flags.append(f"max(CASE WHEN vestype = {v}{cond} THEN 1 ELSE 0 END) AS {name}")
    front = " + ".join(RING_FRONT.values())
    back = " + ".join(RING_BACK.values())
    return f"""WITH {TRACES}, flags AS (SELECT case_id, {', '.join(flags)} FROM tf GROUP BY case_id)
SELECT *, CASE WHEN {front} = 7 AND {back} = 6 THEN 'complete' WHEN {front} = 7 THEN 'front complete'
  WHEN {back} = 6 THEN 'back complete' ELSE 'incomplete' END AS verdict FROM flags"""


@query("ring_completeness", ["fx_points"], _ring_sql(0.5))
def ring_completeness(points):
    return feat.ring_completeness(tr.trace_features(points, carry=["vestype"]), 0.5)
