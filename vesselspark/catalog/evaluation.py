"""Evaluation metrics."""

from pyspark.sql import functions as F

from ..functions.lookups import CLASS_LABELS, sql_values
from ..operators import evaluation as ev
from . import query
from .features import rounded

G, P = "(gt > 0)::INT", "(pred > 0)::INT"


@query("dice", ["fx_voxels"], f"""SELECT case_id, CAST(2 * sum({G} * {P}) AS BIGINT) AS overlapx2, CAST(sum({G} + {P}) AS BIGINT) AS total,
  round((2 * sum({G} * {P}) + 1e-8) / (sum({G} + {P}) + 1e-8), 9) AS dice FROM fx_voxels GROUP BY case_id""")
def dice(v):
    return rounded(ev.dice(v), ["dice"], 9)


@query("dice_half_max", ["fx_voxels"], f"""WITH t AS (SELECT *, intensity > 0.5 * max(intensity) OVER (PARTITION BY case_id) AS m FROM fx_voxels)
SELECT case_id, round(2.0::DOUBLE * sum({G} * m::INT) / sum({G} + m::INT), 9) AS dsc FROM t GROUP BY case_id""")
def dice_half_max(v):
    return rounded(ev.dice_of_ratio(v, "intensity"), ["dsc"], 9)


COUNTS = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn"
RATIOS = """, r AS (SELECT *, tp / (tp + fn + 1e-8) AS se, tp / (tp + fp + 1e-8) AS pc, tn / (tn + fp + 1e-8) AS sp FROM c)
SELECT {keys} tp, fp, fn, tn, round(se, 9) AS sensitivity, round(pc, 9) AS "precision", round(sp, 9) AS specificity, round(2 * pc * se / (pc + se + 1e-8), 9) AS f1 FROM r"""
RATE = ["sensitivity", "precision", "specificity", "f1"]


@query("confusion_point", ["fx_voxels"], f"WITH v AS (SELECT *, gt > 0 AS g, pred > 0 AS p FROM fx_voxels), c AS (SELECT {COUNTS} FROM v)" + RATIOS.format(keys=""))
def confusion_point(v):
    return rounded(ev.confusion(v), RATE, 9)


@query("confusion_slice", ["fx_voxels"], f"""WITH v AS (SELECT case_id, z, bool_or(gt > 0) AS g, bool_or(pred > 0) AS p FROM fx_voxels GROUP BY case_id, z),
c AS (SELECT case_id, {COUNTS} FROM v GROUP BY case_id)""" + RATIOS.format(keys="case_id,"))
def confusion_slice(v):
    return rounded(ev.slice_confusion(v, ["case_id"]), RATE, 9)


PER_CLASS = f"""names(l, label) AS (VALUES {sql_values(CLASS_LABELS.items())}),
side AS (SELECT case_id, gt AS l, gt = pred AS hit FROM fx_voxels WHERE gt > 0 UNION ALL SELECT case_id, pred, false FROM fx_voxels WHERE pred > 0),
per AS (SELECT case_id, l, 2.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*) AS dice FROM side GROUP BY case_id, l)"""


@query("dice_per_class", ["fx_voxels"], f"""WITH {PER_CLASS}, m AS (SELECT case_id, coalesce(2.0::DOUBLE * sum({G} * {P}) / nullif(sum({G} + {P}), 0), 0) AS dice FROM fx_voxels GROUP BY case_id)
SELECT case_id, label, round(dice, 9) AS dice FROM per JOIN names ON per.l = names.l
UNION ALL SELECT m.case_id, 'average', round(coalesce(a, 0), 9) FROM m LEFT JOIN (SELECT case_id, avg(dice) AS a FROM per GROUP BY case_id) q ON m.case_id = q.case_id
UNION ALL SELECT case_id, 'merged', round(dice, 9) FROM m""")
def dice_per_class(v):
    return rounded(ev.dice_per_class(v), ["dice"], 9)


@query("class_mean_dice", ["fx_voxels"], f"WITH {PER_CLASS} SELECT round(avg(d), 9) AS mean_dice FROM (SELECT case_id, avg(dice) AS d FROM per GROUP BY case_id) q")
def class_mean_dice(v):
    per = ev.dice_per_class(v).where("label not in ('average', 'merged')")
    return rounded(ev.class_mean_dice(per), ["mean_dice"], 9)


@query("difference_map", ["fx_voxels"], "SELECT case_id, x, y, z, CASE WHEN gt > 0 AND pred > 0 THEN 3 WHEN gt > 0 THEN 2 WHEN pred > 0 THEN 1 ELSE 0 END AS diff FROM fx_voxels")
def difference_map(v):
    return ev.difference(v).select("case_id", "x", "y", "z", "diff")


OFF = ", ".join(f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0))
OFF6 = ", ".join(str(o) for o in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])
VID = "((({c} * 64 + {x} + 1) * 64 + {y} + 1) * 64 + {z} + 1)"


def cc_sql(name, nodes, offsets):
    """CTEs: {name}_n (nodes with id), {name}_e (edges), {name} (id, comp = least id)."""
    vid = VID.format(c="case_id", x="x", y="y", z="z")
    return f"""{name}_n AS (SELECT case_id, x, y, z, {vid} AS id FROM ({nodes}) q),
{name}_o(a, b, c) AS (VALUES {offsets}),
{name}_e AS (SELECT s.id AS src, t.id AS dst FROM {name}_n s, {name}_o o, {name}_n t WHERE t.case_id = s.case_id AND t.x = s.x + o.a AND t.y = s.y + o.b AND t.z = s.z + o.c),
{name}(id, comp) USING KEY (id) AS (SELECT id, id FROM {name}_n UNION
  SELECT e.dst, min(w.comp) FROM {name} w JOIN {name}_e e ON e.src = w.id JOIN recurring.{name} r ON r.id = e.dst WHERE w.comp < r.comp GROUP BY e.dst)"""


# Voxels and the padded box's background one by one; the operator works on runs.
@query("betti_error", ["fx_voxels"], f"""WITH o(a, b, c) AS MATERIALIZED (VALUES {OFF}),
sd AS (SELECT case_id, 0 AS s, CAST(gt AS VARCHAR) AS label, x, y, z FROM fx_voxels WHERE gt > 0 UNION ALL SELECT case_id, 1, CAST(pred AS VARCHAR), x, y, z FROM fx_voxels WHERE pred > 0),
mk AS (SELECT * FROM sd UNION ALL SELECT case_id, s, 'merged', x, y, z FROM sd),
bx AS (SELECT case_id, s, label, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(z) - 1 AS z0, max(z) + 1 AS z1 FROM mk WHERE label = 'merged' GROUP BY ALL),
bg AS (SELECT case_id, s, label, x, y, z FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM bx) p, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) q, LATERAL (SELECT unnest(range(z0, z1 + 1)) AS z) r
  EXCEPT SELECT * FROM mk),
al AS MATERIALIZED (SELECT 'f' AS part, * FROM mk UNION ALL SELECT 'b', * FROM bg),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY part, case_id, s, label, x, y, z) AS id FROM al),
e AS MATERIALIZED (SELECT p.id AS u, q.id AS v FROM n p, o, n q WHERE q.part = p.part AND q.case_id = p.case_id AND q.s = p.s AND q.label = p.label AND q.x = p.x + a AND q.y = p.y + b AND q.z = p.z + c AND (p.part = 'f' OR abs(a) + abs(b) + abs(c) = 1)),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT e.v, min(c.comp) FROM cc c JOIN e ON e.u = c.id JOIN recurring.cc r ON r.id = e.v WHERE c.comp < r.comp GROUP BY e.v),
k AS (SELECT case_id, s, label, count(DISTINCT comp) FILTER (WHERE part = 'f') AS b0, count(DISTINCT comp) FILTER (WHERE part = 'b') - 1 AS b2 FROM cc JOIN n USING (id) GROUP BY ALL),
cl AS (SELECT DISTINCT case_id, s, 2*x + a AS x, 2*y + b AS y, 2*z + c AS z, 3 - abs(a) - abs(b) - abs(c) AS d FROM mk, (SELECT * FROM o UNION ALL SELECT 0, 0, 0) w WHERE label = 'merged'),
eu AS (SELECT case_id, s, sum(CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END) AS euler FROM cl GROUP BY ALL),
f AS (SELECT case_id, label, abs(sum(CASE WHEN s = 0 THEN b0 ELSE -b0 END)) AS err_b0, abs(sum(CASE WHEN s = 0 THEN 1 ELSE -1 END * (b0 + b2 - euler))) AS err_b1 FROM k LEFT JOIN eu USING (case_id, s) GROUP BY ALL),
ca AS (SELECT DISTINCT case_id FROM fx_voxels)
SELECT case_id, label, CAST(err_b0 AS DOUBLE) AS err_b0, CAST(NULL AS BIGINT) AS err_b1 FROM f WHERE label <> 'merged'
UNION ALL SELECT ca.case_id, 'average', round(coalesce(avg(err_b0), 0), 9), NULL FROM ca LEFT JOIN f ON f.case_id = ca.case_id AND label <> 'merged' GROUP BY ca.case_id
UNION ALL SELECT ca.case_id, 'merged', coalesce(err_b0, 0), coalesce(err_b1, 0) FROM ca LEFT JOIN f ON f.case_id = ca.case_id AND label = 'merged'""")
def betti_error(v):
    return rounded(ev.betti_errors(v), ["err_b0"], 9)


@query("euler_number", ["fx_voxels"], f"""WITH o(a, b, c) AS (VALUES {OFF}, (0, 0, 0)),
c AS (SELECT DISTINCT case_id, 2*x + a AS x, 2*y + b AS y, 2*z + c AS z, 3 - abs(a) - abs(b) - abs(c) AS d FROM fx_voxels, o WHERE gt > 0)
SELECT case_id, CAST(sum(CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS euler FROM c GROUP BY case_id""")
def euler_number(v):
    return ev.euler_number(v.where("gt > 0"))


@query("centreline_dice", ["fx_voxels"], """WITH p AS (SELECT case_id, avg((gt > 0)::INT) AS pr FROM fx_voxels WHERE pred > 0 AND intensity >= 42 GROUP BY case_id),
s AS (SELECT case_id, avg((pred > 0)::INT) AS se FROM fx_voxels WHERE gt > 0 AND intensity >= 42 GROUP BY case_id)
SELECT coalesce(p.case_id, s.case_id) AS case_id, round(coalesce(pr, 0), 9) AS "precision", round(coalesce(se, 0), 9) AS sensitivity,
  round(coalesce(2 * pr * se / nullif(pr + se, 0), 0), 9) AS cldice FROM p FULL JOIN s ON p.case_id = s.case_id""")
def centreline_dice(v):
    gt, pred = v.where("gt > 0"), v.where("pred > 0")
    out = ev.centreline_dice(gt, gt.where("intensity >= 42"), pred, pred.where("intensity >= 42"))
    return rounded(out, ["precision", "sensitivity", "cldice"], 9)


SPACING = (0.6, 0.3, 0.3)


def _assd_sql(name, src):
    """Average symmetric surface distance of masks ``src(case_id, which, side, x, y, z)``; side a / b."""
    return f"""{name}_m AS ({src}), {name}_o(a, b, c) AS (VALUES {OFF6}),
{name}_in AS (SELECT m.case_id, m.which, m.side, m.x, m.y, m.z FROM {name}_m m, {name}_o o, {name}_m n WHERE n.case_id = m.case_id AND n.which = m.which AND n.side = m.side
  AND n.x = m.x + o.a AND n.y = m.y + o.b AND n.z = m.z + o.c GROUP BY ALL HAVING count(*) = 6),
{name}_s AS (SELECT case_id, which, side, x * 0.6::DOUBLE AS x, y * 0.3::DOUBLE AS y, z * 0.3::DOUBLE AS z FROM (SELECT * FROM {name}_m EXCEPT SELECT * FROM {name}_in) q),
{name}_d AS (SELECT a.case_id, a.which, a.side, a.x, a.y, a.z, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d
  FROM {name}_s a JOIN {name}_s b ON a.case_id = b.case_id AND a.which = b.which AND a.side <> b.side GROUP BY ALL),
{name} AS (SELECT case_id, which, avg(m) AS assd FROM (SELECT case_id, which, side, avg(d) AS m FROM {name}_d GROUP BY ALL) q GROUP BY case_id, which HAVING count(*) = 2)"""


def _variants(src, ths):
    top = "(SELECT max(intensity) FROM fx_voxels m WHERE m.case_id = v.case_id)"
    rows = [f"SELECT case_id, 0.0 AS which, 'a' AS side, x, y, z FROM {src} v WHERE pred > 0"]
    rows += [f"SELECT case_id, {t}, 'a', x, y, z FROM {src} v WHERE intensity > {t}::DOUBLE * {top}" for t in ths]
    rows += [f"SELECT case_id, {t}, 'b', x, y, z FROM {src} v WHERE gt > 0" for t in (0.0, *ths)]
    return " UNION ALL ".join(rows)


SURF = f"""WITH roi AS (SELECT * FROM fx_voxels WHERE x >= 2 AND x < 13 AND y >= 3 AND y < 14 AND z >= 1 AND z < 9),
{_assd_sql('w', _variants('fx_voxels', (0.2, 0.3, 0.4)))}, {_assd_sql('r', _variants('roi', (0.4,)))},
ws AS (SELECT case_id, max(assd) FILTER (WHERE which = 0) AS d, avg(assd) FILTER (WHERE which > 0) AS nf FROM w GROUP BY case_id),
rs AS (SELECT case_id, coalesce(max(assd) FILTER (WHERE which = 0), max(assd) FILTER (WHERE which > 0)) AS d, max(assd) FILTER (WHERE which > 0) AS nf FROM r GROUP BY case_id)"""


@query("surface_distance", ["fx_voxels"], SURF + """ SELECT ws.case_id, round(ws.d, 6) AS assd, round(ws.nf, 6) AS nf, round(greatest((ws.nf - ws.d) / ws.nf, 0), 6) AS surface_score,
  round(rs.d, 6) AS assd_roi, round(rs.nf, 6) AS nf_roi, round(greatest((rs.nf - rs.d) / rs.nf, 0), 6) AS surface_score_roi FROM ws LEFT JOIN rs ON ws.case_id = rs.case_id""")
def surface_distance(v):
    out = ev.surface_score(v, SPACING, _roi(v))
    return rounded(out, [c for c in out.columns if c != "case_id"])


def _roi(v):
    box = {"x0": 2, "x1": 13, "y0": 3, "y1": 14, "z0": 1, "z1": 9}
    return v.select("case_id").distinct().select("case_id", *[F.lit(n).alias(c) for c, n in box.items()])


@query("final_score", ["fx_voxels"], SURF + f""", d AS (SELECT case_id, (2 * sum({G} * {P}) + 1e-8) / (sum({G} + {P}) + 1e-8) AS dice FROM fx_voxels GROUP BY case_id),
dr AS (SELECT case_id, (2 * sum({G} * {P}) + 1e-8) / (sum({G} + {P}) + 1e-8) AS dice FROM roi GROUP BY case_id HAVING sum({P}) > 4)
SELECT d.case_id, round(CASE WHEN dr.dice IS NULL THEN 0.5 * d.dice + 0.5 * greatest((ws.nf - ws.d) / ws.nf, 0)
  ELSE 0.35 * d.dice + 0.35 * greatest((ws.nf - ws.d) / ws.nf, 0) + 0.15 * greatest((rs.nf - rs.d) / rs.nf, 0) + 0.15 * dr.dice END, 6) AS final_score
FROM d LEFT JOIN dr ON d.case_id = dr.case_id LEFT JOIN ws ON d.case_id = ws.case_id LEFT JOIN rs ON d.case_id = rs.case_id""")
def final_score(v):
    roi = _roi(v)
    inside = ev.in_roi(v, roi)
    enough = inside.groupBy("case_id").agg(F.count_if(F.col("pred") > 0).alias("n")).where("n > 4")
    part = ev.dice(inside.join(enough, "case_id", "left_semi")).select("case_id", F.col("dice").alias("dice_roi"))
    all_ = ev.dice(v).select("case_id", "dice").join(ev.surface_score(v, SPACING, roi), "case_id", "left").join(part, "case_id", "left")
    return rounded(ev.final_score(all_), ["final_score"]).select("case_id", "final_score")


LADDER = """lad AS (SELECT score, sum(p) OVER w AS tps, sum(n) OVER w - sum(p) OVER w AS fps FROM (SELECT score, sum(y) AS p, count(*) AS n FROM {src} GROUP BY score) q WINDOW w AS (ORDER BY score DESC))"""
ROC = """, d AS (SELECT *, lag(tps) OVER w AS t0, lead(tps) OVER w AS t1, lag(fps) OVER w AS f0, lead(fps) OVER w AS f1 FROM lad WINDOW w AS (ORDER BY score DESC)),
tot AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS n, max(score) + 1 AS top FROM {src})
SELECT round(fps / n, 9) AS fp_rate, round(tps / p, 9) AS tp_rate, round(score, 6) AS threshold FROM d, tot WHERE t0 IS NULL OR t1 IS NULL OR t1 - 2*tps + t0 <> 0 OR f1 - 2*fps + f0 <> 0
UNION ALL SELECT 0, 0, round(top, 6) FROM tot"""
PR = """ SELECT round(tps / CAST(tps + fps AS DOUBLE), 9) AS "precision", round(tps / p, 9) AS recall, round(score, 6) AS threshold FROM lad, (SELECT CAST(sum(y) AS DOUBLE) AS p FROM {src}) t UNION ALL SELECT 1, 0, 99999"""
SLICES = "sl AS (SELECT case_id, slice_id, max(y) AS y, max(score) AS score FROM fx_scores GROUP BY case_id, slice_id), "


@query("roc", ["fx_scores"], ("WITH " + LADDER + ROC).format(src="fx_scores"))
def roc(s):
    return rounded(rounded(ev.roc_curve(s), ["fp_rate", "tp_rate"], 9), ["threshold"])


@query("roc_slices", ["fx_scores"], ("WITH " + SLICES + LADDER + ROC).format(src="sl"))
def roc_slices(s):
    return rounded(rounded(ev.roc_curve(ev.slice_scores(s, ["case_id", "slice_id"])), ["fp_rate", "tp_rate"], 9), ["threshold"])


@query("pr", ["fx_scores"], ("WITH " + LADDER + PR).format(src="fx_scores"))
def pr(s):
    return rounded(rounded(ev.pr_curve(s), ["precision", "recall"], 9), ["threshold"])


@query("pr_slices", ["fx_scores"], ("WITH " + SLICES + LADDER + PR).format(src="sl"))
def pr_slices(s):
    return rounded(rounded(ev.pr_curve(ev.slice_scores(s, ["case_id", "slice_id"])), ["precision", "recall"], 9), ["threshold"])


@query("dice_curve", ["fx_scores"], """WITH l AS (SELECT min(score) AS lo, (max(score) - min(score)) / 79 AS gap FROM fx_scores),
t AS (SELECT lo + k * gap AS th FROM l, unnest(generate_series(0, 79)) AS g(k))
SELECT round((2 * count(*) FILTER (WHERE y = 1 AND score > th) + 1e-8) / (sum(y) + count(*) FILTER (WHERE score > th) + 1e-8), 9) AS dice, round(th, 6) AS threshold FROM t, fx_scores GROUP BY th""")
def dice_curve(s):
    return rounded(rounded(ev.dice_curve(s), ["dice"], 9), ["threshold"])


IOU = """ious AS (SELECT p.image_id, p.cls, p.box_id AS l, p.score, g.box_id AS r, i / ((p.x1-p.x0)*(p.y1-p.y0)*(p.z1-p.z0) + (g.x1-g.x0)*(g.y1-g.y0)*(g.z1-g.z0) - i) AS iou
  FROM {a} p JOIN {b} g ON p.image_id = g.image_id AND p.cls = g.cls, LATERAL (SELECT CAST(greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0))
  * greatest(0, least(p.z1, g.z1) - greatest(p.z0, g.z0)) AS DOUBLE) AS i) q)"""


@query("box_iou", ["fx_boxes_pred", "fx_boxes_gt"], "WITH " + IOU.format(a="fx_boxes_pred", b="fx_boxes_gt") + ' SELECT image_id, cls, l AS "left", r AS "right", round(iou, 9) AS iou FROM ious WHERE iou > 0')
def box_iou(pred, gt):
    return rounded(ev.box_ious(pred, gt), ["iou"], 9)


@query("box_topk", ["fx_boxes_pred"], "SELECT image_id, box_id, place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS place FROM fx_boxes_pred WHERE score > 0.46) q WHERE place <= 5")
def box_topk(pred):
    return ev.top_boxes(pred, 5, score_above=0.46).select("image_id", "box_id", F.col("place").cast("bigint").alias("place"))


@query("box_nms", ["fx_boxes_pred"], "WITH " + IOU.format(a="fx_boxes_pred", b="fx_boxes_pred") + """, o AS (SELECT image_id, cls, box_id, score, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, box_id) AS k FROM fx_boxes_pred),
riv AS (SELECT l AS box_id, list(r) AS rivals FROM ious WHERE l <> r AND iou > 0.22 GROUP BY l),
st(image_id, cls, k, kept) AS (SELECT DISTINCT image_id, cls, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o UNION ALL
  SELECT s.image_id, s.cls, s.k + 1, CASE WHEN list_has_any(coalesce(v.rivals, CAST([] AS BIGINT[])), s.kept) THEN s.kept ELSE list_append(s.kept, o.box_id) END
  FROM st s JOIN o ON o.image_id = s.image_id AND o.cls = s.cls AND o.k = s.k + 1 LEFT JOIN riv v ON v.box_id = o.box_id)
SELECT image_id, cls, unnest(arg_max(kept, k)) AS box_id FROM st GROUP BY image_id, cls""")
def box_nms(pred):
    return ev.non_maximum_suppression(pred, 0.22).select("image_id", "cls", "box_id")


MATCH = "WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY score DESC, box_id) AS k FROM fx_boxes_pred) q WHERE k <= 10), " + IOU.format(a="o", b="fx_boxes_gt") + """,
c AS (SELECT i.image_id, i.cls, o.k, list({'s': -iou, 'r': r} ORDER BY -iou, r) AS opts FROM ious i JOIN o ON o.box_id = i.l WHERE iou >= 0.5 GROUP BY ALL),
st(image_id, cls, k, taken, hit) AS (SELECT DISTINCT image_id, cls, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM o UNION ALL
  SELECT s.image_id, s.cls, s.k + 1, CASE WHEN f IS NULL THEN s.taken ELSE list_append(s.taken, f) END, f FROM (
    SELECT s.*, list_filter(list_transform(coalesce(c.opts, []), lambda e: e.r), lambda r: NOT list_contains(s.taken, r))[1] AS f
    FROM st s JOIN o ON o.image_id = s.image_id AND o.cls = s.cls AND o.k = s.k + 1 LEFT JOIN c ON c.image_id = s.image_id AND c.cls = s.cls AND c.k = s.k + 1) s),
m AS (SELECT o.box_id, o.cls, o.score, hit FROM st JOIN o ON o.image_id = st.image_id AND o.cls = st.cls AND o.k = st.k)"""


@query("box_match", ["fx_boxes_pred", "fx_boxes_gt"], MATCH + ' SELECT box_id AS "left", hit AS "right" FROM m WHERE hit IS NOT NULL')
def box_match(pred, gt):
    return ev.match_boxes(ev.top_boxes(pred, 10, ("image_id", "cls")), gt).select("left", "right")


@query("average_precision", ["fx_boxes_pred", "fx_boxes_gt"], MATCH + """, cum AS (SELECT cls, sum((hit IS NOT NULL)::INT) OVER w AS tp, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY cls ORDER BY score DESC, box_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT cls, count(*) AS ngt FROM fx_boxes_gt GROUP BY cls),
p AS (SELECT g.cls, k, coalesce(max(tp / CAST(n AS DOUBLE)) FILTER (WHERE tp * 100 >= k * ngt), 0) AS p FROM g JOIN cum ON g.cls = cum.cls, unnest(generate_series(0, 100)) AS s(k) GROUP BY g.cls, k)
SELECT cls, round(avg(p), 9) AS ap FROM p GROUP BY cls""")
def average_precision(pred, gt):
    return rounded(ev.average_precision(pred, gt), ["ap"], 9)


@query("patch_weight", ["fx_boxes_gt", "fx_meta"], """WITH m AS (SELECT idx, list_transform(string_split(trim(pos_s, '[]'), ', '), lambda s: CAST(s AS INT)) AS b FROM fx_meta)
SELECT box_id, CASE WHEN len(b) = 6 AND b[1] < x1 AND b[2] > x0 AND b[3] < y1 AND b[4] > y0 AND b[5] < z1 AND b[6] > z0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM fx_boxes_gt JOIN m ON m.idx = box_id""")
def patch_weight(patches, meta):
    from ..sources.tables import parse_meta

    b = parse_meta(meta).where("size(pos_s) = 6").select(
        F.col("idx").alias("box_id"), *[F.col("pos_s")[i].alias(n) for i, n in enumerate(("x0_b", "x1_b", "y0_b", "y1_b", "z0_b", "z1_b"))]
    )
    return ev.patch_weight(patches, b, ["box_id"]).select("box_id", "weight")


@query("inside_box", ["fx_points", "fx_boxes_gt"], """SELECT b.box_id, p.trace_id, p.seq FROM fx_points p JOIN fx_boxes_gt b ON p.case_id = b.image_id
WHERE abs(p.x - (b.x0 + b.x1) / 2) <= (b.x1 - b.x0) / 2 AND abs(p.y - (b.y0 + b.y1) / 2) <= (b.y1 - b.y0) / 2""")
def inside_box(p, b):
    boxes = b.select(
        F.col("image_id").alias("case_id"), "box_id", ((F.col("x0") + F.col("x1")) / 2).alias("bx"), ((F.col("y0") + F.col("y1")) / 2).alias("by"),
        (F.col("x1") - F.col("x0")).alias("bw"), (F.col("y1") - F.col("y0")).alias("bh"),
    )
    at = p.select("case_id", "trace_id", "seq", F.col("x").alias("px"), F.col("y").alias("py"))
    return ev.inside_box2d(at, boxes, ["case_id"]).select("box_id", "trace_id", "seq")


LARGEST = "list_position(embedding, list_max(embedding)) - 1"


@query("label_accuracy", ["embeddings"], f"""WITH n AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS c, ({LARGEST} = label)::INT AS ok FROM embeddings),
g AS (SELECT c, sum(ok) AS r, count(*) AS n, min(ok) AS a FROM n GROUP BY c) SELECT round(sum(r) / sum(n), 9) AS accuracy, round(avg(a), 9) AS solved FROM g""")
def label_accuracy(e):
    top = F.col("embedding")
    nodes = e.select(
        F.floor(F.col("vec_id") / 2).alias("case_id"), F.col("label").alias("true"), (F.array_position(top, F.array_max(top)) - 1).alias("pred")
    )
    return rounded(ev.label_accuracy(nodes), ["accuracy", "solved"], 9)


@query("epoch_metrics", ["events"], """WITH m AS (SELECT CAST(ts AS DATE) AS epoch, CASE WHEN event_type IN ('click', 'view') THEN concat('seg_', event_type) ELSE event_type END AS name, value, 1 + event_id % 3 AS n FROM events)
SELECT CAST(epoch AS VARCHAR) AS epoch, name, round(CASE WHEN name LIKE 'seg!_%' ESCAPE '!' THEN sum(value) ELSE sum(value * n) / sum(n) END, 6) AS value FROM m GROUP BY epoch, name""")
def epoch_metrics(e):
    return rounded(ev.epoch_metrics(metric_rows(e)), ["value"])


def metric_rows(e):
    kind = F.col("event_type")
    return e.select(
        F.to_date("ts").cast("string").alias("epoch"), F.when(kind.isin("click", "view"), F.concat(F.lit("seg_"), kind)).otherwise(kind).alias("name"),
        "value", (1 + F.col("event_id") % 3).alias("n"),
    )


@query("agreement", ["fx_voxels"], """SELECT case_id, count(*) FILTER (WHERE gt > 0 AND pred > 0) AS "both", count(*) FILTER (WHERE gt > 0 AND pred = 0) AS only_gt, count(*) FILTER (WHERE gt = 0 AND pred > 0) AS only_pred,
  round(avg(abs(score - (gt > 0)::INT)), 9) AS mean_abs FROM fx_voxels GROUP BY case_id""")
def agreement(v):
    return rounded(ev.agreement(v), ["mean_abs"], 9)


@query("grid_search", ["lineitem"], """WITH m AS (SELECT l_linenumber, l_returnflag, l_linestatus, round(avg(l_quantity), 9) AS mean_score FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY mean_score DESC, l_linenumber, l_returnflag, l_linestatus) = 1 AS best FROM m""")
def grid_search(li):
    s = li.select("l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("score"))
    return rounded(ev.grid_search(s, ["l_linenumber", "l_returnflag", "l_linestatus"]), ["mean_score"], 9)


@query("loss_metrics", ["fx_voxels"], """WITH p AS (SELECT case_id, avg(-((gt > 0)::INT * -ln(1 + exp(-score)) + (1 - (gt > 0)::INT) * -(score + ln(1 + exp(-score))))) AS ce,
  1 - 2 * sum(score * (gt > 0)::INT) / (sum(score + (gt > 0)::INT) + 1e-6) AS sd, 1.0::DOUBLE + max(z) AS w FROM fx_voxels GROUP BY case_id)
SELECT round(avg(w * ce) / avg(w), 9) AS ce, round(avg(w * sd) / avg(w), 9) AS soft_dice FROM p""")
def loss_metrics(v):
    w = v.groupBy("case_id").agg((F.max("z") + 1.0).alias("w"))
    return rounded(ev.loss_metrics(v, w), ["ce", "soft_dice"], 9)


def _critical(rule):
    other = "gt NOT IN (1, 2)" if rule == "inclusion" else "gt = 2"
    return f"""SELECT '{rule}' AS rule, s.case_id, s.x, s.y, s.z FROM fx_voxels s WHERE (gt = 1 AND EXISTS (SELECT 1 FROM fx_voxels t, o WHERE t.case_id = s.case_id AND t.x = s.x + o.a AND t.y = s.y + o.b AND t.z = s.z + o.c AND t.{other}))
  OR (s.{other} AND EXISTS (SELECT 1 FROM fx_voxels t, o WHERE t.case_id = s.case_id AND t.x = s.x + o.a AND t.y = s.y + o.b AND t.z = s.z + o.c AND t.gt = 1))"""


@query("critical_voxels", ["fx_voxels"], f"WITH o(a, b, c) AS (VALUES {OFF}) {_critical('exclusion')} UNION ALL {_critical('inclusion')}")
def critical_voxels(v):
    lab = v.withColumn("label", F.col("gt"))
    a = ev.critical_voxels(lab, 1, 2, False).withColumn("rule", F.lit("exclusion"))
    return a.unionByName(ev.critical_voxels(lab, 1, 2, True).withColumn("rule", F.lit("inclusion")))
