"""Ordered operators along a trace."""

from pyspark.sql import functions as F

from ..operators import traces as tr
from . import query
from .features import STEPS, rounded

W = "WINDOW w AS (PARTITION BY case_id, trace_id ORDER BY seq)"
P4 = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(rad, 6) AS rad"
ID = ["case_id", "trace_id", "seq"]
ACC = STEPS + """, acc AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY case_id, trace_id ORDER BY seq
  ROWS UNBOUNDED PRECEDING) AS s FROM steps)"""


def pts(df):
    return rounded(df, ["x", "y", "z", "rad"]).select(*ID, "x", "y", "z", "rad")


@query("accumulated_length", ["fx_points"], f"WITH {ACC} SELECT case_id, trace_id, seq, round(s, 6) AS acc FROM acc")
def accumulated_length(points):
    return rounded(tr.accumulated_length(points), ["acc"]).select(*ID, "acc")


@query("direction", ["fx_points"], f"""SELECT case_id, trace_id, seq,
  coalesce(lead(x) OVER w - x, x - lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w - y, y - lag(y) OVER w, y) AS dy,
  coalesce(lead(z) OVER w - z, z - lag(z) OVER w, z) AS dz FROM fx_points {W}""")
def direction(points):
    return tr.direction(points).select(*ID, "dx", "dy", "dz")


@query("tangent", ["fx_points"], f"""WITH u AS (SELECT case_id, trace_id, seq, CASE WHEN step > 0 THEN (x-px)/step WHEN step = 0 THEN 0 END AS ux,
  CASE WHEN step > 0 THEN (y-py)/step WHEN step = 0 THEN 0 END AS uy, CASE WHEN step > 0 THEN (z-pz)/step WHEN step = 0 THEN 0 END AS uz
  FROM ({"WITH " + STEPS + " SELECT * FROM steps"}) q)
SELECT case_id, trace_id, seq, round(coalesce(ux, 0) + coalesce(lead(ux) OVER w, 0), 6) AS tx,
  round(coalesce(uy, 0) + coalesce(lead(uy) OVER w, 0), 6) AS ty, round(coalesce(uz, 0) + coalesce(lead(uz) OVER w, 0), 6) AS tz
FROM u {W}""")
def tangent(points):
    return rounded(tr.tangent(points), ["tx", "ty", "tz"]).select(*ID, "tx", "ty", "tz")


@query("resample", ["fx_points"], f"""WITH {ACC}, seg AS (
  SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(rad) OVER w AS r1 FROM acc {W}),
whole AS (SELECT case_id, trace_id, max(s) AS len, greatest(3, CAST(floor(max(s) / 0.75) AS BIGINT)) AS n FROM acc
  GROUP BY case_id, trace_id HAVING count(*) > 1),
want AS (SELECT case_id, trace_id, len, k, k * len / (n - 1) AS t FROM whole, LATERAL unnest(generate_series(0, n - 1)) AS g(k)),
hit AS (SELECT w.case_id, w.trace_id, k, t, max(seq) AS seq FROM want w JOIN seg g
  ON w.case_id = g.case_id AND w.trace_id = g.trace_id AND s <= t AND s1 IS NOT NULL AND s < len GROUP BY ALL)
SELECT h.case_id, h.trace_id, k AS seq, round(x + (x1-x)*f, 6) AS x, round(y + (y1-y)*f, 6) AS y, round(z + (z1-z)*f, 6) AS z,
  round(rad + (r1-rad)*f, 6) AS rad
FROM (SELECT h.case_id, h.trace_id, h.k, g.x, g.y, g.z, g.rad, g.x1, g.y1, g.z1, g.r1,
      CASE WHEN s1 > s THEN least(1, (t - s) / (s1 - s)) ELSE 0 END AS f
      FROM hit h JOIN seg g ON h.case_id = g.case_id AND h.trace_id = g.trace_id AND h.seq = g.seq) h""")
def resample(points):
    return pts(tr.resample(points, 0.75))


@query("resample_slices", ["fx_points"], f"""WITH u AS (SELECT case_id, trace_id, z, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_min(rad, seq) AS rad
  FROM fx_points GROUP BY case_id, trace_id, z),
seg AS (SELECT *, lead(z) OVER w AS z1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(rad) OVER w AS r1 FROM u
  WINDOW w AS (PARTITION BY case_id, trace_id ORDER BY z)),
want AS (SELECT case_id, trace_id, k FROM (SELECT case_id, trace_id, CAST(ceil(min(z)) AS BIGINT) AS a, CAST(floor(max(z)) AS BIGINT) AS b
  FROM u GROUP BY case_id, trace_id) q, LATERAL unnest(generate_series(a, b)) AS g(k)),
hit AS (SELECT w.case_id, w.trace_id, k, max(z) AS z FROM want w JOIN seg g ON w.case_id = g.case_id AND w.trace_id = g.trace_id AND z <= k GROUP BY ALL)
SELECT case_id, trace_id, k AS seq, round(x + coalesce((x1-x)*f, 0), 6) AS x, round(y + coalesce((y1-y)*f, 0), 6) AS y, CAST(k AS DOUBLE) AS z,
  round(rad + coalesce((r1-rad)*f, 0), 6) AS rad
FROM (SELECT h.case_id, h.trace_id, h.k, g.x, g.y, g.rad, g.x1, g.y1, g.r1, (h.k - g.z) / (g.z1 - g.z) AS f
      FROM hit h JOIN seg g ON h.case_id = g.case_id AND h.trace_id = g.trace_id AND h.z = g.z) q""")
def resample_slices(points):
    return pts(tr.resample_at_slices(points))


def _axis_sql(chunk):
    if chunk is None:
        runs = "SELECT *, 0 AS c, seq AS i, np AS m FROM sized"
        post = "SELECT case_id, trace_id, seq, x, y, z, rad FROM out"
    else:
        runs = f"""SELECT *, seq // {chunk} AS c, seq % {chunk} AS i, least(np, {chunk}) AS m FROM sized WHERE np <= {chunk} OR seq // {chunk} < np // {chunk}
          UNION ALL SELECT *, np // {chunk}, seq - (np - {chunk}), {chunk} FROM sized WHERE np > {chunk} AND np % {chunk} <> 0 AND seq >= np - {chunk}"""
        tail = f"(np > {chunk} AND c = np // {chunk})"
        post = f"""SELECT case_id, trace_id, CASE WHEN {tail} THEN np - {chunk} + seq ELSE c * {chunk} + seq END AS seq, x, y, z, rad
          FROM out WHERE NOT {tail} OR seq >= np // {chunk} * {chunk} - (np - {chunk})"""
    return f"""WITH sized AS (SELECT p.*, count(*) OVER (PARTITION BY case_id, trace_id) AS np FROM fx_points p),
runs AS ({runs}),
ax AS (SELECT case_id, trace_id, c, arg_min(x, i) AS ax, arg_min(y, i) AS ay, arg_min(z, i) AS az,
  arg_max(x, i) - arg_min(x, i) AS bx, arg_max(y, i) - arg_min(y, i) AS b_y, arg_max(z, i) - arg_min(z, i) AS bz FROM runs GROUP BY ALL),
ax2 AS (SELECT *, CASE WHEN bx*bx + b_y*b_y + bz*bz = 0 THEN 1 ELSE sqrt(bx*bx + b_y*b_y + bz*bz) END AS bl FROM ax),
proj AS (SELECT r.case_id, r.trace_id, r.c, np, m, i, x, y, z, rad, round((x-ax)*(bx/bl) + (y-ay)*(b_y/bl) + (z-az)*(bz/bl), 9) AS s
  FROM runs r JOIN ax2 a ON r.case_id = a.case_id AND r.trace_id = a.trace_id AND r.c = a.c),
u AS (SELECT case_id, trace_id, c, np, m, s, arg_min(x, i) AS x, arg_min(y, i) AS y, arg_min(z, i) AS z, arg_min(rad, i) AS rad FROM proj GROUP BY ALL),
seg AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(rad) OVER w AS r1 FROM u
  WINDOW w AS (PARTITION BY case_id, trace_id, c ORDER BY s)),
lim AS (SELECT case_id, trace_id, c, max(m) AS m, CAST(ceil(min(s)) AS BIGINT) AS lo, CAST(floor(max(s)) AS BIGINT) AS hi
  FROM u GROUP BY ALL HAVING count(*) > 1),
want AS (SELECT *, lo + k * CAST(hi - lo AS DOUBLE) / (m - 1) AS t FROM lim, LATERAL unnest(generate_series(0, m - 1)) AS g(k) WHERE m > 1 AND hi >= lo),
hit AS (SELECT w.case_id, w.trace_id, w.c, k, t, max(s) AS s FROM want w JOIN seg g ON w.case_id = g.case_id AND w.trace_id = g.trace_id AND w.c = g.c
  AND s <= t AND s1 IS NOT NULL GROUP BY ALL),
out AS (SELECT case_id, trace_id, c, np, k AS seq, round(x + (x1-x)*f, 6) AS x, round(y + (y1-y)*f, 6) AS y, round(z + (z1-z)*f, 6) AS z, round(rad + (r1-rad)*f, 6) AS rad
 FROM (SELECT g.*, h.k, least(1, (h.t - g.s) / (g.s1 - g.s)) AS f FROM hit h JOIN seg g
   ON h.case_id = g.case_id AND h.trace_id = g.trace_id AND h.c = g.c AND h.s = g.s) q)
{post}"""


@query("resample_axis", ["fx_points"], _axis_sql(None))
def resample_axis(points):
    return pts(tr.resample_along_axis(points))


@query("resample_axis_runs", ["fx_points"], _axis_sql(25))
def resample_axis_runs(points):
    return pts(tr.resample_along_axis(points, chunk=25))


@query("moving_average", ["fx_points"], f"""WITH m AS (SELECT *, lead(seq, 2) OVER w AS e2, avg(x) OVER v AS mx, avg(y) OVER v AS my, avg(z) OVER v AS mz, avg(rad) OVER v AS mr
  FROM fx_points WINDOW w AS (PARTITION BY case_id, trace_id ORDER BY seq), v AS (PARTITION BY case_id, trace_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT case_id, trace_id, seq, round(CASE WHEN seq <= 2 OR e2 IS NULL THEN x ELSE mx END, 6) AS x, round(CASE WHEN seq <= 2 OR e2 IS NULL THEN y ELSE my END, 6) AS y,
  round(CASE WHEN seq <= 2 OR e2 IS NULL THEN z ELSE mz END, 6) AS z, round(CASE WHEN seq <= 2 OR e2 IS NULL THEN rad ELSE mr END, 6) AS rad FROM m""")
def moving_average(points):
    return pts(tr.moving_average(points))


@query("radius_trim", ["fx_points"], """WITH e AS (SELECT case_id, trace_id, count(*) AS n, max(CASE WHEN seq = 0 THEN rad END) AS h0, max(CASE WHEN seq = 3 THEN rad END) AS h3,
  arg_max(rad, seq) AS t0, max(CASE WHEN back = 3 THEN rad END) AS t3 FROM (SELECT *, row_number() OVER (PARTITION BY case_id, trace_id ORDER BY seq DESC) - 1 AS back FROM fx_points) q
  GROUP BY case_id, trace_id)
SELECT p.case_id, p.trace_id, p.seq, CASE WHEN n >= 8 AND seq < 3 AND h0 > h3 * 1.5 THEN h3 WHEN n >= 8 AND seq >= n - 3 AND t0 > t3 * 1.5 THEN t3 ELSE rad END AS rad
FROM fx_points p JOIN e ON p.case_id = e.case_id AND p.trace_id = e.trace_id""")
def radius_trim(points):
    return tr.trim_end_radius(points).select(*ID, "rad")


@query("sharp_turn", ["fx_points"], f"""WITH v AS (SELECT case_id, trace_id, lead(x, 2) OVER w - x AS ax, lead(y, 2) OVER w - y AS ay, lead(z, 2) OVER w - z AS az,
  x - lag(x, 2) OVER w AS bx, y - lag(y, 2) OVER w AS b_y, z - lag(z, 2) OVER w AS bz FROM fx_points {W}),
a AS (SELECT *, CASE WHEN ax IS NULL OR bx IS NULL THEN NULL WHEN (ax*ax+ay*ay+az*az) * (bx*bx+b_y*b_y+bz*bz) = 0 THEN 90
  ELSE degrees(acos(greatest(-1, least(1, (ax*bx+ay*b_y+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+b_y*b_y+bz*bz)))))) END AS ang FROM v)
SELECT case_id, trace_id, round(coalesce(max(ang), 0), 4) AS max_angle, coalesce(max(ang), 0) > 145.5 AS sharp FROM a GROUP BY case_id, trace_id""")
def sharp_turn(points):
    return rounded(tr.sharp_turn(points, 145.5), ["max_angle"], 4)


@query("position_energy", ["fx_points"], f"""WITH d AS (SELECT case_id, trace_id, {', '.join(f"abs({c} - lag({c}) OVER w) AS f{c}, abs({c} - 2 * lag({c}) OVER w + lag({c}, 2) OVER w) AS s{c}" for c in 'xyz')} FROM fx_points {W})
SELECT case_id, trace_id, round(coalesce(sum(fx + fy + fz), 0) + 5 * coalesce(sum(sx + sy + sz), 0), 6) AS energy FROM d GROUP BY case_id, trace_id""")
def position_energy(points):
    return rounded(tr.position_energy(points), ["energy"])


@query("direction_cut", ["fx_points"], f"""WITH v AS (SELECT *, lag(x) OVER w - lag(x, 2) OVER w AS ax, lag(y) OVER w - lag(y, 2) OVER w AS ay, lag(z) OVER w - lag(z, 2) OVER w AS az,
  lead(x, 2) OVER w - lead(x) OVER w AS bx, lead(y, 2) OVER w - lead(y) OVER w AS b_y, lead(z, 2) OVER w - lead(z) OVER w AS bz FROM fx_points {W}),
b AS (SELECT *, CASE WHEN ax IS NULL OR bx IS NULL THEN 0 WHEN (ax*ax+ay*ay+az*az) * (bx*bx+b_y*b_y+bz*bz) = 0 THEN 1
  WHEN (ax*bx+ay*b_y+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+b_y*b_y+bz*bz)) < 0.25 THEN 1 ELSE 0 END AS brk FROM v),
c AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY case_id, trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece FROM b),
n AS (SELECT *, count(*) OVER (PARTITION BY case_id, trace_id, piece) AS np, seq - min(seq) OVER (PARTITION BY case_id, trace_id, piece) AS s FROM c)
SELECT case_id, trace_id, piece, s AS seq, ev FROM n WHERE np >= 2""")
def direction_cut(points):
    return tr.split_at(tr.direction_breaks(points), "brk").select("case_id", "trace_id", "piece", "seq", "ev")


@query("vessel_runs", ["fx_points", "fx_pred_points"], f"""WITH k AS (SELECT DISTINCT case_id, x, y, z FROM fx_pred_points),
f AS (SELECT p.*, k.x IS NOT NULL AS hit FROM fx_points p LEFT JOIN k ON p.case_id = k.case_id AND p.x = k.x AND p.y = k.y AND p.z = k.z),
c AS (SELECT *, CASE WHEN lag(hit) OVER w IS DISTINCT FROM hit THEN 1 ELSE 0 END AS ch FROM f {W}),
r AS (SELECT *, sum(ch) OVER (PARTITION BY case_id, trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT case_id, trace_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS np FROM r WHERE hit GROUP BY case_id, trace_id, run HAVING count(*) > 2""")
def vessel_runs(points, pred):
    from ..functions.geometry import position_cells, vec

    key = lambda df: df.withColumn("_key", position_cells(vec("x", "y", "z")))
    seen = key(pred).select("case_id", "_key").distinct().withColumn("_hit", F.lit(True))
    flagged = key(points).join(seen, ["case_id", "_key"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False)))
    return tr.islands(flagged.select(*ID, "hit"), "hit")


SEQ2 = "row_number() OVER (PARTITION BY case_id, trace_id ORDER BY seq) - 1 AS seq"


@query("remove_short", ["fx_points"], """SELECT case_id, trace_id, seq, ev FROM (SELECT *, count(*) OVER (PARTITION BY case_id, trace_id) AS n FROM fx_points) q WHERE n > 65""")
def remove_short(points):
    return tr.remove_short(points, 65).select(*ID, "ev")


@query("remove_large", ["fx_points"], """SELECT case_id, trace_id, seq, ev FROM (SELECT *, avg(rad) OVER (PARTITION BY case_id, trace_id) AS n FROM fx_points) q WHERE n <= 1.95""")
def remove_large(points):
    return tr.remove_large(points, 1.95).select(*ID, "ev")


@query("valid_traces", ["fx_points", "labels"], """SELECT p.case_id, p.trace_id, p.seq, p.ev FROM fx_points p
WHERE p.trace_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def valid_traces(points, labels):
    flags = points.select("case_id", "trace_id").distinct().join(
        labels.select(F.col("doc_id").alias("trace_id"), F.col("quality").alias("ok")), "trace_id"
    )
    return tr.valid(points, flags).select(*ID, "ev")


@query("trim_range", ["fx_points"], """SELECT case_id, trace_id, seq, ev FROM fx_points
WHERE NOT (x < 35 OR x > 46 - 1 OR y < 34 OR y > 47 - 1 OR z < 30 OR z > 50 - 1)""")
def trim_range(points):
    return tr.trim_range(points, (35, 46, 34, 47, 30, 50)).select(*ID, "ev")


@query("sub_trace", ["fx_points"], "SELECT case_id, trace_id, seq - 10 AS seq, ev FROM fx_points WHERE seq >= 10 AND seq < 40")
def sub_trace(points):
    return tr.sub_trace(points, 10, 40).select(*ID, "ev")


@query("points_at_slice", ["fx_points"], "SELECT case_id, trace_id, seq, ev FROM fx_points WHERE abs(z - 41.5) < 1")
def points_at_slice(points):
    return tr.points_at(points, 41.5).select(*ID, "ev")


@query("dedupe_points", ["fx_points"], f"WITH {STEPS} SELECT case_id, trace_id, {SEQ2}, ev FROM steps WHERE step IS NULL OR step >= 0.001")
def dedupe_points(points):
    return tr.remove_duplicate_points(points).select(*ID, "ev")


@query("self_loop", ["fx_points"], f"""WITH l AS (SELECT *, max(seq) OVER (PARTITION BY case_id, trace_id, x, y, z) AS ls FROM fx_points),
m AS (SELECT *, max(ls) OVER (PARTITION BY case_id, trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS reach FROM l)
SELECT case_id, trace_id, {SEQ2}, ev FROM m WHERE reach <= seq""")
def self_loop(points):
    return tr.remove_self_loop(points).select(*ID, "ev")


@query("reverse", ["fx_points"], "SELECT case_id, trace_id, max(seq) OVER (PARTITION BY case_id, trace_id) - seq AS seq, ev FROM fx_points")
def reverse(points):
    return tr.reverse(points).select(*ID, "ev")


@query("arrange_direction", ["fx_points"], """WITH e AS (SELECT case_id, trace_id, arg_min(rad, seq) AS h, arg_max(rad, seq) AS t, max(seq) AS top FROM fx_points GROUP BY case_id, trace_id)
SELECT p.case_id, p.trace_id, CASE WHEN h < t THEN top - seq ELSE seq END AS seq, ev FROM fx_points p JOIN e ON p.case_id = e.case_id AND p.trace_id = e.trace_id""")
def arrange_direction(points):
    return tr.reverse(points, only_thin_head=True).select(*ID, "ev")


@query("trace_has_nan", ["fx_points"], """SELECT case_id, trace_id, bool_or(isnan(x) OR isnan(y) OR isnan(z)) AS has_nan FROM fx_points GROUP BY case_id, trace_id""")
def trace_has_nan(points):
    return tr.has_nan(points)


@query("intensity_cut", ["fx_points"], f"""WITH v AS (SELECT *, lag(x) OVER w - lag(x, 2) OVER w AS ax, lag(y) OVER w - lag(y, 2) OVER w AS ay, lag(z) OVER w - lag(z, 2) OVER w AS az,
  lead(x, 2) OVER w - lead(x) OVER w AS bx, lead(y, 2) OVER w - lead(y) OVER w AS b_y, lead(z, 2) OVER w - lead(z) OVER w AS bz FROM fx_points {W}),
b AS (SELECT *, CASE WHEN ax IS NULL OR bx IS NULL THEN false WHEN (ax*ax+ay*ay+az*az) * (bx*bx+b_y*b_y+bz*bz) = 0 THEN true
  ELSE (ax*bx+ay*b_y+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+b_y*b_y+bz*bz)) < 0.25 END AS brk FROM v),
rc(case_id, trace_id, seq, n, s, q, piece) AS (SELECT case_id, trace_id, seq, 1, rad, rad * rad, 0 FROM b WHERE seq = 0 UNION ALL
  SELECT case_id, trace_id, seq, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN rad ELSE s + rad END, CASE WHEN cut THEN rad * rad ELSE q + rad * rad END, piece + cut::INT FROM (
    SELECT b.case_id, b.trace_id, b.seq, b.rad, r.n, r.s, r.q, r.piece, brk OR (n >= 5 AND abs(b.rad - s/n) > 1.2 * sqrt(greatest(0, q/n - (s/n)*(s/n))) + 1e-9) AS cut FROM rc r JOIN b ON b.trace_id = r.trace_id AND b.seq = r.seq + 1) c),
k AS (SELECT p.*, piece, count(*) OVER (PARTITION BY p.trace_id, piece) AS np, p.seq - min(p.seq) OVER (PARTITION BY p.trace_id, piece) AS i FROM rc r JOIN fx_points p ON p.trace_id = r.trace_id AND p.seq = r.seq)
SELECT case_id, trace_id, CAST(piece AS BIGINT) AS piece, CASE WHEN np = 2 AND i = 1 THEN 2 ELSE i END AS seq, x, y, z, round(rad, 6) AS rad FROM k WHERE np > 1
UNION ALL SELECT case_id, trace_id, CAST(piece AS BIGINT), 1, avg(x), avg(y), avg(z), round(avg(rad), 6) FROM k WHERE np = 2 GROUP BY ALL""")
def intensity_cut(points):
    from ..operators.cutting import intensity_cuts

    # The radius stands for the sampled intensity.
    return rounded(intensity_cuts(points, "rad", nstd=1.2), ["rad"])


@query("overlap_breaks", ["fx_points"], f"""WITH {ACC}, c AS (SELECT *, concat_ws('/', trunc(x), trunc(y), trunc(z)) AS cell FROM acc),
rc(case_id, trace_id, seq, cells, accs, cut) AS (SELECT case_id, trace_id, seq, [cell], [s], CAST(NULL AS BIGINT) FROM c WHERE seq = 0 UNION ALL
  SELECT case_id, trace_id, seq, CASE WHEN hit THEN CAST([] AS VARCHAR[]) ELSE list_append(cells, cell) END, CASE WHEN hit THEN CAST([] AS DOUBLE[]) ELSE list_append(accs, s) END, CASE WHEN hit THEN CAST(floor((seq + j) / 2) AS BIGINT) END FROM (
    SELECT *, coalesce(s - accs[k] > floor(rad) AND seq - j > 5, false) AS hit FROM (SELECT c.case_id, c.trace_id, c.seq, c.cell, c.s, c.rad, r.cells, r.accs, list_position(r.cells, c.cell) AS k, c.seq - len(r.cells) + list_position(r.cells, c.cell) - 1 AS j
      FROM rc r JOIN c ON c.trace_id = r.trace_id AND c.seq = r.seq + 1) q) h)
SELECT case_id, trace_id, cut FROM rc WHERE cut IS NOT NULL""")
def overlap_breaks(points):
    from ..operators.cutting import overlap_breaks as breaks

    return breaks(points)
