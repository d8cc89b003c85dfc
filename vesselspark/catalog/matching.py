"""Joins by position."""

from pyspark.sql import functions as F

from ..operators import matching as mt, tracking as tk, traces as tr
from . import query
from .features import STEPS, rounded

D = "sqrt((q.x-t.x)*(q.x-t.x) + (q.y-t.y)*(q.y-t.y) + (q.z-t.z)*(q.z-t.z))"
NEAR_OTHER = f"""near AS (SELECT q.case_id, q.trace_id AS q_trace, q.seq AS q_seq, q.rad AS q_rad, t.trace_id, t.seq, t.rad, {D} AS d FROM fx_points q JOIN fx_points t
  ON q.case_id = t.case_id AND q.trace_id <> t.trace_id AND abs(q.x - t.x) < 5 AND abs(q.y - t.y) < 5 AND abs(q.z - t.z) < 5 WHERE {D} < 5)"""


@query("nearest_point", ["fx_points"], f"""WITH {NEAR_OTHER}, r AS (SELECT *, row_number() OVER (PARTITION BY q_trace, q_seq ORDER BY d, trace_id, seq) AS rn FROM near)
SELECT case_id, q_trace AS q_trace_id, q_seq, trace_id, seq, rad, round(d, 6) AS dist FROM r WHERE rn = 1""")
def nearest_point(p):
    return rounded(mt.nearest_other(mt.as_queries(p), p), ["dist"])


@query("nearest_per_trace", ["fx_points"], f"""WITH {NEAR_OTHER}, r AS (SELECT *, row_number() OVER (PARTITION BY q_trace, q_seq, trace_id ORDER BY d, seq) AS rn FROM near)
SELECT case_id, q_trace AS q_trace_id, q_seq, trace_id, seq, round(d, 6) AS dist FROM r WHERE rn = 1""")
def nearest_per_trace(p):
    return rounded(mt.nearest_per_trace(mt.as_queries(p), p), ["dist"])


def _in_trace_sql(limit):
    return f"""WITH q AS (SELECT case_id, lm_type, x, y, z FROM fx_landmarks), c AS (SELECT DISTINCT case_id, trace_id FROM fx_points),
n AS (SELECT t.case_id, t.trace_id, q.lm_type, q.x, q.y, q.z, t.seq, {D} AS d FROM q JOIN fx_points t ON q.case_id = t.case_id WHERE {limit}),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, trace_id, lm_type, x, y, z ORDER BY d, seq) AS rn FROM n)
SELECT case_id, trace_id, lm_type, x AS lx, y AS ly, z AS lz, seq, round(d, 6) AS dist FROM r WHERE rn = 1"""


def _in_trace(p, lm, r):
    q = lm.join(p.select("case_id", "trace_id").distinct(), "case_id").distinct().select(
        "case_id", "trace_id", F.struct("lm_type", "x", "y", "z").alias("q_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"]
    )
    out = mt.nearest_in_trace(q, p, r)
    return rounded(out, ["dist"]).select(
        "case_id", "trace_id", F.col("q_id.lm_type").alias("lm_type"), *[F.col(f"q_id.{c}").alias(f"l{c}") for c in "xyz"], "seq", "dist"
    )


@query("nearest_in_trace", ["fx_points", "fx_landmarks"], _in_trace_sql(f"{D} <= 4"))
def nearest_in_trace(p, lm):
    return _in_trace(p, lm, 4.0)


@query("nearest_in_trace_any", ["fx_points", "fx_landmarks"], _in_trace_sql("true"))
def nearest_in_trace_any(p, lm):
    return _in_trace(p, lm, None)


@query("trace_min_dist", ["fx_points"], f"""SELECT q.case_id, q.trace_id AS trace_a, t.trace_id AS trace_b, round(min({D}), 6) AS dist FROM fx_points q JOIN fx_points t ON q.case_id = t.case_id AND q.trace_id < t.trace_id
WHERE {D} < 8 GROUP BY ALL""")
def trace_min_dist(p):
    return rounded(mt.trace_distance(p, 8.0), ["dist"])


@query("in_trace", ["fx_points", "fx_pred_points"], f"""SELECT DISTINCT q.case_id, q.trace_id AS q_trace_id, q.seq AS q_seq FROM fx_points q JOIN fx_pred_points t ON q.case_id = t.case_id WHERE {D} < 0.6""")
def in_trace(p, pred):
    return mt.in_traces(mt.as_queries(p), pred, 0.6)


@query("landmark_nodes", ["fx_landmarks", "fx_points"], """SELECT l.case_id, lm_type, p.trace_id, p.seq FROM fx_landmarks l JOIN fx_points p ON l.case_id = p.case_id AND l.x = p.x AND l.y = p.y AND l.z = p.z""")
def landmark_nodes(lm, p):
    return mt.landmark_nodes(lm, p).select("case_id", "lm_type", "trace_id", "seq")


LAST = "last AS (SELECT case_id, trace_id, max(seq) AS top FROM fx_points GROUP BY case_id, trace_id)"


@query("branch_candidates", ["fx_points"], f"""WITH {NEAR_OTHER}, {LAST}, r AS (SELECT *, row_number() OVER (PARTITION BY q_trace, q_seq ORDER BY d, trace_id, seq) AS rn FROM near)
SELECT r.case_id, q_trace AS q_trace_id, CASE WHEN q_seq = 0 THEN 0 ELSE 1 END AS q_end, r.trace_id, seq, round(d, 6) AS dist FROM r JOIN last a ON a.trace_id = q_trace JOIN last b ON b.trace_id = r.trace_id
WHERE rn = 1 AND (q_seq = 0 OR q_seq = a.top) AND d > 0 AND seq > 0 AND seq < b.top AND d < rad + q_rad""")
def branch_candidates(p):
    return rounded(mt.branch_candidates(p), ["dist"]).select("case_id", "q_trace_id", "q_end", "trace_id", "seq", "dist")


ENDS = """e AS (SELECT case_id, trace_id, arg_min(x, seq) AS hx, arg_min(y, seq) AS hy, arg_min(z, seq) AS hz, arg_max(x, seq) AS tx, arg_max(y, seq) AS ty, arg_max(z, seq) AS tz FROM fx_points GROUP BY case_id, trace_id)"""


def _dd(a, b):
    return f"sqrt(({a[0]}-{b[0]})*({a[0]}-{b[0]}) + ({a[1]}-{b[1]})*({a[1]}-{b[1]}) + ({a[2]}-{b[2]})*({a[2]}-{b[2]}))"


def _e(t, s):
    return [f"{t}.{s}{c}" for c in "xyz"]


NEIGH = f"""{ENDS}, pr AS (SELECT m.case_id, m.trace_id AS q_trace_id, o.trace_id, {_dd(_e('o', 'h'), _e('m', 't'))} AS d1, {_dd(_e('o', 't'), _e('m', 't'))} AS d2,
  least({_dd(_e('o', 'h'), _e('m', 'h'))}, {_dd(_e('o', 't'), _e('m', 'h'))}) AS hd FROM e m JOIN e o ON m.case_id = o.case_id AND m.trace_id <> o.trace_id
  WHERE NOT EXISTS (SELECT 1 FROM fx_points p WHERE p.trace_id = m.trace_id AND ((p.x = o.hx AND p.y = o.hy AND p.z = o.hz) OR (p.x = o.tx AND p.y = o.ty AND p.z = o.tz)))),
ng AS (SELECT case_id, q_trace_id, trace_id, least(d1, d2) AS dist, CASE WHEN d1 > d2 THEN 1 ELSE 0 END AS reversed FROM pr WHERE hd >= least(d1, d2) AND least(d1, d2) > 0 AND least(d1, d2) < 15)"""


@query("neighbour_segments", ["fx_points"], f"WITH {NEIGH} SELECT case_id, q_trace_id, trace_id, round(dist, 6) AS dist, reversed FROM ng")
def neighbour_segments(p):
    return rounded(mt.neighbour_segments(p), ["dist"])


REP = f"""{LAST}, ep AS (SELECT p.case_id, p.trace_id, p.seq, x, y, z, 0 AS "end", seq AS k FROM fx_pred_points p WHERE seq < 5
  UNION ALL SELECT p.case_id, p.trace_id, p.seq, x, y, z, 1, top - seq FROM fx_pred_points p JOIN (SELECT trace_id, max(seq) AS top FROM fx_pred_points GROUP BY trace_id) l ON p.trace_id = l.trace_id WHERE top - seq < 5),
nn AS (SELECT q.trace_id, q.seq, t.trace_id AS m, t.seq AS ms, row_number() OVER (PARTITION BY q.trace_id, q.seq, q."end" ORDER BY {D}, t.trace_id, t.seq) AS rn, q."end" AS "end"
  FROM ep q JOIN fx_points t ON q.case_id = t.case_id WHERE {D} < 3),
vo AS (SELECT e.case_id, e.trace_id, e."end", e.k, coalesce(m, -1) AS m, coalesce(ms, -1) AS ms FROM ep e LEFT JOIN (SELECT * FROM nn WHERE rn = 1) n ON n.trace_id = e.trace_id AND n.seq = e.seq AND n."end" = e."end"),
ct AS (SELECT case_id, trace_id, "end", m, count(*) AS n, min(k) AS k0, arg_min(ms, k) AS ms FROM vo GROUP BY ALL),
rep AS (SELECT *, row_number() OVER (PARTITION BY trace_id, "end" ORDER BY n DESC, k0) AS rn FROM ct)"""


@query("representative", ["fx_pred_points", "fx_points"], f'WITH {REP} SELECT case_id, trace_id, "end", m AS ref_trace, ms AS ref_seq FROM rep WHERE rn = 1')
def representative(pred, p):
    return mt.representative(pred, p)


def resample_sql(src, name, gap=1.0):
    """CTEs that resample ``src`` at equal arc length into {name}(case_id, trace_id, seq, x, y, z, rad)."""
    n = name
    w = "WINDOW w AS (PARTITION BY case_id, trace_id ORDER BY seq)"
    return f"""{n}_a AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w) + (y-lag(y) OVER w)*(y-lag(y) OVER w) + (z-lag(z) OVER w)*(z-lag(z) OVER w)), 0) AS st FROM {src} {w}),
{n}_s AS (SELECT *, sum(st) OVER (PARTITION BY case_id, trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM {n}_a),
{n}_g AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(rad) OVER w AS r1 FROM {n}_s {w}),
{n}_w AS (SELECT case_id, trace_id, len, n, k, k * len / (n - 1) AS t FROM (SELECT case_id, trace_id, max(s) AS len, greatest(3, CAST(floor(max(s) / {gap}) AS BIGINT)) AS n FROM {n}_s GROUP BY case_id, trace_id HAVING count(*) > 1) q, LATERAL unnest(generate_series(0, n - 1)) AS u(k)),
{n}_h AS (SELECT w.case_id, w.trace_id, k, t, max(seq) AS seq FROM {n}_w w JOIN {n}_g g ON w.case_id = g.case_id AND w.trace_id = g.trace_id AND s <= t AND s1 IS NOT NULL AND (s < len OR len = 0) GROUP BY ALL),
{n} AS MATERIALIZED (SELECT case_id, trace_id, k AS seq, x + (x1-x)*f AS x, y + (y1-y)*f AS y, z + (z1-z)*f AS z, rad + (r1-rad)*f AS rad FROM (
  SELECT g.*, h.k, CASE WHEN g.s1 > g.s THEN least(1, (h.t - g.s) / (g.s1 - g.s)) ELSE 0 END AS f FROM {n}_h h JOIN {n}_g g ON h.case_id = g.case_id AND h.trace_id = g.trace_id AND h.seq = g.seq) q
  UNION ALL SELECT case_id, trace_id, seq, x, y, z, rad FROM {n}_s WHERE (case_id, trace_id) IN (SELECT (case_id, trace_id) FROM {n}_s GROUP BY case_id, trace_id HAVING count(*) = 1))"""


def _cmap(a, b, name, own):
    r = "q.rad" if own else "t.rad"
    return f"""{name}_n AS (SELECT q.trace_id, q.seq, t.trace_id AS mt, t.seq AS ms, {r} AS rad, {D} AS d, row_number() OVER (PARTITION BY q.trace_id, q.seq ORDER BY {D}, t.trace_id, t.seq) AS rn
  FROM {a} q JOIN {b} t ON q.case_id = t.case_id AND abs(q.x - t.x) < 5 AND abs(q.y - t.y) < 5 AND abs(q.z - t.z) < 5 WHERE {D} < 5),
{name} AS MATERIALIZED (SELECT q.case_id, q.trace_id, q.seq, n.d, n.rad FROM {a} q LEFT JOIN (SELECT * FROM {name}_n WHERE rn = 1) n ON n.trace_id = q.trace_id AND n.seq = q.seq)"""


def _side(m, tag):
    return f"""{tag}_l AS (SELECT trace_id, avg((d IS NULL)::INT) > 0.5 AS gone FROM {m} GROUP BY trace_id),
{tag}_f AS (SELECT m.*, gone, coalesce(max((d IS NOT NULL AND rad < 0.75 / 0.4297)::INT) OVER w, 0) AS thin, coalesce(max((d IS NOT NULL AND d >= rad)::INT) OVER w, 0) AS err
  FROM {m} m JOIN {tag}_l l ON m.trace_id = l.trace_id WINDOW w AS (PARTITION BY m.case_id, m.trace_id ORDER BY m.seq ROWS UNBOUNDED PRECEDING)),
{tag} AS (SELECT case_id, count(*) FILTER (WHERE NOT gone AND d < rad) AS tp_ov, count(*) FILTER (WHERE gone OR d IS NULL OR d >= rad) AS f_ov,
  count(*) FILTER (WHERE NOT gone AND d < rad AND thin = 0) AS tp_ot, count(*) FILTER (WHERE gone OR (d >= rad AND thin = 0)) AS f_ot,
  count(*) FILTER (WHERE NOT gone AND d < rad AND err = 0) AS tp_of, count(*) FILTER (WHERE gone OR (d IS NOT NULL AND err = 1)) AS f_of,
  count(*) FILTER (WHERE gone OR d IS NULL) AS um, count(DISTINCT CASE WHEN gone THEN trace_id END) AS ums, sum(d) FILTER (WHERE NOT gone AND d < rad) AS dsum FROM {tag}_f GROUP BY case_id)"""


# The second tracing carries no vessel that matches exactly, so radii decide the outcome.
OVERLAP = f"{resample_sql('fx_pred_points', 'tr')}, {resample_sql('fx_points', 'rf')}, {_cmap('tr', 'rf', 'cm', False)}, {_cmap('rf', 'tr', 'rm', True)}, {_side('cm', 'a')}, {_side('rm', 'b')}"


@query("comparison_map", ["fx_pred_points", "fx_points"], f"""WITH {resample_sql('fx_pred_points', 'tr')}, {resample_sql('fx_points', 'rf')}, {_cmap('tr', 'rf', 'cm', False)}, {_cmap('rf', 'tr', 'rm', True)}
SELECT 'traced' AS side, case_id, trace_id, seq, round(d, 5) AS dist FROM cm UNION ALL SELECT 'reference', case_id, trace_id, seq, round(d, 5) FROM rm""")
def comparison_map(pred, p):
    a, b = mt.comparison_map(pred, p)
    cols = ["case_id", "trace_id", "seq", F.round("dist", 5).alias("dist")]
    return a.select(F.lit("traced").alias("side"), *cols).unionByName(b.select(F.lit("reference").alias("side"), *cols))


@query("trace_overlap", ["fx_pred_points", "fx_points"], f"""WITH {OVERLAP} SELECT coalesce(a.case_id, b.case_id) AS case_id,
  round((a.tp_ov + b.tp_ov) / CAST(a.tp_ov + b.tp_ov + a.f_ov + b.f_ov AS DOUBLE), 6) AS ov, round(b.tp_of / CAST(b.tp_of + b.f_of AS DOUBLE), 6) AS "of",
  round((a.tp_ot + b.tp_ot) / CAST(a.tp_ot + b.tp_ot + a.f_ot + b.f_ot AS DOUBLE), 6) AS ot, round(b.dsum / b.tp_ov, 6) AS ai,
  a.um, a.ums, b.um AS ref_um, b.ums AS ref_ums, round(a.dsum / a.tp_ov, 6) AS mean_dist FROM a FULL JOIN b ON a.case_id = b.case_id""")
def trace_overlap(pred, p):
    return rounded(mt.trace_overlap(pred, p), ["ov", "of", "ot", "ai", "mean_dist"])


@query("mot_metrics", ["fx_points", "fx_pred_points"])
def mot_metrics(p, pred):
    vessels = tk.vessel_order(tr.resample(p, 1.0).join(p.select("case_id", "trace_id", "vestype").distinct(), ["case_id", "trace_id"]))
    return rounded(tk.mot_metrics(vessels, pred), ["MOTA", "MOTP", "IDF1"])


@query("combined_evaluation", ["fx_points", "fx_pred_points"])
def combined_evaluation(p, pred):
    return mot_metrics(p, pred).select("case_id", "MOTA", "IDF1", "MOTP", "IDS").join(trace_overlap(pred, p).select("case_id", "ov"), "case_id", "full")


SHIFT = "sp AS (SELECT case_id, trace_id, seq, x - 32.25 AS x, y - 32 AS y, z - 36.75 AS z, rad FROM fx_points)"
CORNER = """co AS (SELECT * FROM (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b), (VALUES (0), (1)) c(c))"""


def shifted(p):
    return p.select("case_id", "trace_id", "seq", (F.col("x") - 32.25).alias("x"), (F.col("y") - 32).alias("y"), (F.col("z") - 36.75).alias("z"), "rad")


def sample_sql(src, ids):
    return f"""(SELECT {', '.join('k.' + i for i in ids)}, sum(w * coalesce(v.intensity, 0)) AS v FROM (SELECT p.*, floor(x) + a AS vx, floor(y) + b AS vy, floor(z) + c AS vz,
  (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE c WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM {src} p, co) k
  LEFT JOIN fx_voxels v ON v.case_id = k.case_id AND v.x = vx AND v.y = vy AND v.z = vz GROUP BY ALL)"""


IDS = ["case_id", "trace_id", "seq"]


@query("sample_linear", ["fx_points", "fx_voxels"], f"WITH {SHIFT}, {CORNER} SELECT case_id, trace_id, seq, round(v, 6) AS v FROM {sample_sql('sp', IDS)} q")
def sample_linear(p, v):
    return rounded(mt.sample(shifted(p), v, "intensity", IDS), ["v"])


@query("sample_nearest", ["fx_points", "fx_voxels"], f"""WITH {SHIFT} SELECT p.case_id, trace_id, seq, coalesce(intensity, 0) AS v FROM sp p LEFT JOIN fx_voxels v ON v.case_id = p.case_id AND v.x = ceil(p.x - 0.5) AND v.y = ceil(p.y - 0.5) AND v.z = ceil(p.z - 0.5)""")
def sample_nearest(p, v):
    return mt.sample(shifted(p), v, "intensity", IDS, linear=False)


def _around_sql(keep):
    return f"""WITH {SHIFT}, {CORNER}, nb AS (SELECT p.case_id, trace_id, seq, i * 100 + j * 10 + k AS o, x + i AS x, y + j AS y, z + k AS z FROM sp p, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j), (VALUES (-1), (0), (1)) k(k) WHERE {keep})
SELECT case_id, trace_id, seq, round(avg(v), 6) AS v FROM {sample_sql('nb', [*IDS, 'o'])} q GROUP BY ALL"""


@query("mean_in_cube", ["fx_points", "fx_voxels"], _around_sql("true"))
def mean_in_cube(p, v):
    return rounded(mt.mean_around(shifted(p), v, "intensity", IDS), ["v"])


@query("mean_in_ball", ["fx_points", "fx_voxels"], _around_sql("i*i + j*j + k*k <= 1"))
def mean_in_ball(p, v):
    return rounded(mt.mean_around(shifted(p), v, "intensity", IDS, ball=True), ["v"])


@query("ring_profile", ["fx_points", "fx_voxels"], f"""WITH {SHIFT}, {CORNER}, dr AS (SELECT *, coalesce(lead(x) OVER w - x, x - lag(x) OVER w, x) AS xn, coalesce(lead(y) OVER w - y, y - lag(y) OVER w, y) AS yn, coalesce(lead(z) OVER w - z, z - lag(z) OVER w, z) AS zn
  FROM sp WINDOW w AS (PARTITION BY case_id, trace_id ORDER BY seq)),
q AS (SELECT *, yn*yn + zn*zn AS side, sqrt(pow(yn*yn + zn*zn, 2) + xn*xn*yn*yn + xn*xn*zn*zn) AS root FROM dr),
a AS (SELECT q.*, angle, CASE WHEN angle < 0 THEN 0 ELSE rad * 2 * cos(radians(angle)) END AS u, CASE WHEN angle < 0 THEN 0 ELSE rad * 2 * sin(radians(angle)) END AS w FROM q, unnest([-1, 0, 30, 60, 90, 120, 150, 180, 210, 240, 270, 300, 330]) AS g(angle)),
pos AS (SELECT case_id, trace_id, seq, angle, x + CASE WHEN side = 0 THEN 0 ELSE u*side/root END AS x, y + CASE WHEN side = 0 THEN w ELSE -u*xn*yn/root + w*zn/sqrt(side) END AS y, z + CASE WHEN side = 0 THEN -u ELSE -u*zn*xn/root - w*yn/sqrt(side) END AS z FROM a)
SELECT case_id, trace_id, seq, angle, round(v + 1e-7, 5) AS v FROM {sample_sql('pos', [*IDS, 'angle'])} z""")
def ring_profile(p, v):
    out = mt.profile(shifted(p), v, "intensity")
    return out.withColumn("v", F.round(F.col("v") + 1e-7, 5))  # values on a rounding edge go one way in both engines


@query("fit_radius", ["fx_points", "fx_voxels"], f"""WITH {SHIFT}, pb AS (SELECT p.*, r, a, b, c FROM sp p, generate_series(1, 9) g(r), (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) o(a, b, c)),
ct AS (SELECT pb.case_id, trace_id, seq, r, count(v.x) AS ct FROM pb LEFT JOIN fx_voxels v ON v.case_id = pb.case_id AND v.x = round_even(pb.x + r*a, 0) AND v.y = round_even(pb.y + r*b, 0) AND v.z = round_even(pb.z + r*c, 0) AND v.intensity > 12 GROUP BY ALL)
SELECT case_id, trace_id, seq, round(coalesce(min(r) FILTER (WHERE ct < 3) + arg_min(ct, r) FILTER (WHERE ct < 3) / 6, 9), 6) AS fit_rad FROM ct GROUP BY ALL""")
def fit_radius(p, v):
    return rounded(mt.radius_from_mask(shifted(p), v.where("intensity > 12"), IDS), ["fit_rad"])


def _ball_sql(r, upper):
    return f"""b AS (SELECT case_id, trace_id, seq, rad, cx + i AS vx, cy + j AS vy, cz + k AS vz, i = 0 AND j = 0 AND k = 0 AS mid, cx + i - x AS ox, cy + j - y AS oy, cz + k - z AS oz,
  sqrt((cx+i-x)*(cx+i-x) + (cy+j-y)*(cy+j-y) + (cz+k-z)*(cz+k-z)) AS d FROM (SELECT *, CAST(round_even(x, 0) AS BIGINT) AS cx, CAST(round_even(y, 0) AS BIGINT) AS cy, CAST(round_even(z, 0) AS BIGINT) AS cz, CAST({r} AS BIGINT) AS ri FROM fx_points) p,
  LATERAL unnest(generate_series(-ri, greatest(ri + {upper}, -ri))) AS u1(i), LATERAL unnest(generate_series(-ri, greatest(ri + {upper}, -ri))) AS u2(j), LATERAL unnest(generate_series(-ri, greatest(ri + {upper}, -ri))) AS u3(k)),
bb AS (SELECT * FROM b WHERE d <= rad OR mid)"""


@query("paint_last", ["fx_points"], f"WITH {_ball_sql('round_even(rad, 0)', -1)} SELECT case_id, vx, vy, vz, max(trace_id) AS trace_id FROM bb GROUP BY ALL")
def paint_last(p):
    return mt.paint_last(p)


@query("paint_unique", ["fx_points"], f"""WITH {_ball_sql('round_even(rad, 0)', 0)}, t AS (SELECT case_id, vx, vy, vz, max(trace_id) FILTER (WHERE mid) AS m, min(trace_id) AS lo, max(trace_id) AS hi FROM bb GROUP BY ALL)
SELECT case_id, vx, vy, vz, CASE WHEN m IS NOT NULL THEN CASE WHEN hi > m THEN -1 ELSE m END WHEN lo = hi THEN lo ELSE -1 END AS trace_id FROM t""")
def paint_unique(p):
    return mt.paint_unique(p)


@query("paint_distance", ["fx_points"], f"""WITH {_ball_sql('ceil(rad)', -1)}, r AS (SELECT *, CASE WHEN mid THEN 1 ELSE (rad - d) / rad END AS w, row_number() OVER (PARTITION BY case_id, vx, vy, vz
  ORDER BY CASE WHEN mid THEN 1 ELSE (rad - d) / rad END DESC, mid DESC, CASE WHEN mid THEN -trace_id ELSE trace_id END, CASE WHEN mid THEN -seq ELSE seq END) AS rn FROM bb)
SELECT case_id, vx, vy, vz, round(w, 6) AS w, ox, oy, oz FROM r WHERE rn = 1 AND w > 0""")
def paint_distance(p):
    return rounded(mt.paint_distance(p), ["w"])


@query("centreline_map", ["fx_points"], """WITH v AS (SELECT case_id, trace_id, seq, CAST(round_even(x, 0) AS BIGINT) AS vx, CAST(round_even(y, 0) AS BIGINT) AS vy, CAST(round_even(z, 0) AS BIGINT) AS vz FROM fx_points),
o AS (SELECT *, min(trace_id) OVER (PARTITION BY case_id, vx, vy, vz) AS own FROM v)
SELECT case_id, vx, vy, vz, own AS trace_id, max(seq) FILTER (WHERE trace_id = own) AS seq, count(*) FILTER (WHERE trace_id <> own) AS conflicts FROM o GROUP BY ALL""")
def centreline_map(p):
    return mt.centreline_map(p)


@query("surrounding_voxels", ["fx_points"], """WITH c AS (SELECT DISTINCT case_id, trace_id, CAST(round_even(x, 0) AS BIGINT) AS x, CAST(round_even(y, 0) AS BIGINT) AS y, CAST(round_even(z, 0) AS BIGINT) AS z FROM fx_points)
SELECT DISTINCT case_id, trace_id, x + i AS x, y + j AS y, z + k AS z FROM c, generate_series(-2, 2) a(i), generate_series(-2, 2) b(j), generate_series(-2, 2) d(k)
WHERE i*i + j*j + k*k <= 4 AND x + i BETWEEN 0 AND 44 AND y + j BETWEEN 0 AND 44 AND z + k BETWEEN 0 AND 44""")
def surrounding_voxels(p):
    return mt.surrounding_voxels(p, 2, (45, 45, 45))


@query("crossing_links", ["fx_points"], f"""WITH {NEIGH}, {_ball_sql('round_even(rad, 0)', 0)}, t AS (SELECT case_id, vx, vy, vz, max(trace_id) FILTER (WHERE mid) AS m, min(trace_id) AS lo, max(trace_id) AS hi FROM bb GROUP BY ALL),
pu AS (SELECT case_id, vx, vy, vz, CASE WHEN m IS NOT NULL THEN CASE WHEN hi > m THEN -1 ELSE m END WHEN lo = hi THEN lo ELSE -1 END AS own FROM t),
ln AS (SELECT n.case_id, q_trace_id AS ta, n.trace_id AS tb, a.tx AS ax, a.ty AS ay, a.tz AS az, CASE reversed WHEN 1 THEN b.tx ELSE b.hx END AS bx, CASE reversed WHEN 1 THEN b.ty ELSE b.hy END AS b_y, CASE reversed WHEN 1 THEN b.tz ELSE b.hz END AS bz
  FROM ng n JOIN e a ON a.trace_id = q_trace_id JOIN e b ON b.trace_id = n.trace_id),
st AS (SELECT l.*, n, k FROM (SELECT *, CAST(floor(sqrt((ax-bx)*(ax-bx) + (ay-b_y)*(ay-b_y) + (az-bz)*(az-bz))) AS BIGINT) AS n FROM ln) l, LATERAL unnest(generate_series(0, n)) AS g(k)),
sv AS (SELECT case_id, ta, tb, CAST(round_even(CASE WHEN k = n THEN bx ELSE ax + (bx-ax) * (k/n) END, 0) AS BIGINT) AS vx, CAST(round_even(CASE WHEN k = n THEN b_y ELSE ay + (b_y-ay) * (k/n) END, 0) AS BIGINT) AS vy, CAST(round_even(CASE WHEN k = n THEN bz ELSE az + (bz-az) * (k/n) END, 0) AS BIGINT) AS vz FROM st)
SELECT DISTINCT s.case_id, ta AS trace_a, tb AS trace_b FROM sv s JOIN pu ON pu.case_id = s.case_id AND pu.vx = s.vx AND pu.vy = s.vy AND pu.vz = s.vz WHERE own NOT IN (-1, ta, tb)""")
def crossing_links(p):
    return mt.crossing_links(end_links(p), mt.paint_unique(p))


def end_links(p):
    ng = mt.neighbour_segments(p)
    e = mt.ends(p).select("case_id", "trace_id", "end", "x", "y", "z")
    a = e.where("end = 1").select("case_id", F.col("trace_id").alias("trace_a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = e.select("case_id", F.col("trace_id").alias("trace_b"), "end", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    ln = ng.select("case_id", F.col("q_trace_id").alias("trace_a"), F.col("trace_id").alias("trace_b"), F.col("reversed").alias("end"))
    return ln.join(a, ["case_id", "trace_a"]).join(b, ["case_id", "trace_b", "end"])


@query("rotation_frames", ["fx_points"])
def rotation_frames(p):
    from ..operators.frames import rotation_frames as frames

    out = frames(tr.remove_duplicate_points(p))
    return rounded(out, [f"{a}{c}" for a in "uv" for c in "xyz"]).select(*IDS, *[f"{a}{c}" for a in "uv" for c in "xyz"])


@query("curve_coordinates", ["fx_points"])
def curve_coordinates(p):
    curve = tr.resample(tr.moving_average(p), 2.0)
    around = mt.surrounding_voxels(curve, 1, (200, 200, 200))
    out = mt.curve_coordinates(around, curve, 2.0)
    return rounded(out, ["u", "v", "w"])
