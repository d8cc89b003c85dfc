"""Volumes and cohorts."""

from pyspark.sql import functions as F

from ..operators import points as op, volumes as vol
from . import query
from .evaluation import OFF, OFF6, cc_sql
from .features import rounded

PS = ", ".join(map(str, vol.PERCENTILES))


@query("percentile_landmarks", ["fx_voxels"], f"""SELECT case_id, p, round(quantile_cont, 6) AS q FROM (SELECT case_id, unnest([{', '.join(f'{float(p)}::DOUBLE' for p in vol.PERCENTILES)}]) AS p, unnest(quantile_cont(intensity, [{PS}])) AS quantile_cont
  FROM fx_voxels WHERE intensity > 0 GROUP BY case_id) q""")
def percentile_landmarks(v):
    return rounded(vol.percentile_landmarks(v), ["q"])


REF = [1, 6, 11, 16, 22, 28, 33, 39, 45, 52, 60, 61]


def _lut_sql():
    parts = []
    for i in range(11):
        j = min(i, 9)
        stop = "CAST(trunc(q[12]) AS BIGINT)" if i == 10 else f"CAST(trunc(q[{i + 2}]) AS BIGINT) - 1"
        parts.append(f"list_transform(generate_series(CAST(trunc(q[{i + 1}]) AS BIGINT), {stop}), lambda v: CAST(round_even({float(REF[i])}::DOUBLE + {float(REF[j + 1] - REF[j])}::DOUBLE / nullif(q[{j + 2}] - q[{j + 1}], 0) * (v - q[{i + 1}]), 0) AS BIGINT))")
    flat = "[CAST(0 AS BIGINT)]"
    for p in parts:
        flat = f"list_concat({flat}, {p})"
    return f"""WITH l AS (SELECT case_id, quantile_cont(intensity, [{PS}]) AS q FROM fx_voxels WHERE intensity > 0 GROUP BY case_id), t AS (SELECT case_id, {flat} AS lut FROM l)
SELECT v.case_id, x, y, z, lut[CAST(trunc(intensity) AS BIGINT) + 1] AS mapped FROM fx_voxels v JOIN t ON v.case_id = t.case_id"""


@query("standardise", ["fx_voxels"], _lut_sql())
def standardise(v):
    return vol.standardise(v, REF).select("case_id", "x", "y", "z", "mapped")


@query("max_projection", ["fx_voxels"], "SELECT case_id, x, y, max(intensity) AS intensity FROM fx_voxels GROUP BY case_id, x, y")
def max_projection(v):
    return vol.projection(v, "z", "intensity")


@query("label_inventory", ["fx_voxels"], """SELECT case_id, list_sort(list(DISTINCT CAST(gt AS INTEGER))) AS present, list_filter([0, 1, 2, 3, 15], lambda e: NOT list_contains(list(DISTINCT CAST(gt AS INTEGER)), e)) AS missing FROM fx_voxels GROUP BY case_id""")
def label_inventory(v):
    return vol.label_inventory(v, "gt", [0, 1, 2, 3, 15])


FG = "SELECT case_id, x, y, z FROM fx_voxels WHERE gt > 0"


@query("voxel_components", ["fx_voxels"], f"""WITH {cc_sql('c', FG, OFF)}, s AS (SELECT n.case_id, comp, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM c JOIN c_n n ON n.id = c.id GROUP BY n.case_id, comp)
SELECT case_id, n, x0, x1, y0, y1, z0, z1 FROM s""")
def voxel_components(v):
    from ..plans.voxelgrid import TWENTY_SIX, mask_components

    comp = mask_components(v.where("gt > 0"), TWENTY_SIX)
    return comp.groupBy("case_id", "comp").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))]
    ).drop("comp")


EXT = "ext AS (SELECT case_id, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM fx_voxels GROUP BY case_id)"


def extent(v):
    return v.groupBy("case_id").agg(*[(F.max(c) + 1).alias(f"n{c}") for c in "xyz"])


@query("component_filter", ["fx_voxels"], f"""WITH {cc_sql('c', 'SELECT case_id, x, y, z FROM fx_voxels WHERE intensity > 20', OFF6)}, {EXT},
p AS (SELECT n.case_id, comp, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c JOIN c_n n ON n.id = c.id GROUP BY n.case_id, comp),
k AS (SELECT p.case_id, comp FROM p JOIN ext e ON p.case_id = e.case_id WHERE (SELECT count(*) FROM p q WHERE q.case_id = p.case_id) = 1 OR (n >= 20 AND sqrt(pow(mx - nx/2, 2) + pow(my - ny/2, 2) + pow(mz - nz/2, 2)) <= 0.8 * sqrt(pow(nx/2, 2) + pow(ny/2, 2) + pow(nz/2, 2))))
SELECT n.case_id, x, y, z FROM c JOIN c_n n ON n.id = c.id JOIN k ON k.case_id = n.case_id AND k.comp = c.comp""")
def component_filter(v):
    return vol.keep_components(v.where("intensity > 20"), extent(v))


@query("remove_touching", ["fx_voxels"], f"""WITH {cc_sql('c', 'SELECT case_id, x, y, z FROM fx_voxels WHERE intensity > 36', OFF6)}, bad AS (SELECT DISTINCT comp FROM c JOIN c_n n ON n.id = c.id WHERE n.z = 0)
SELECT n.case_id, x, y, z FROM c JOIN c_n n ON n.id = c.id WHERE comp NOT IN (SELECT comp FROM bad)""")
def remove_touching(v):
    m = v.where("intensity > 36")
    return vol.remove_touching(m, m.where("z = 0"))


@query("largest_component", ["fx_voxels"], f"""WITH {cc_sql('c', FG, OFF)}, s AS (SELECT n.case_id, comp, count(*) AS n, row_number() OVER (PARTITION BY n.case_id ORDER BY count(*) DESC, comp) AS place FROM c JOIN c_n n ON n.id = c.id GROUP BY n.case_id, comp)
SELECT case_id, place, n FROM s WHERE place <= 2""")
def largest_component(v):
    return vol.top_components(v.where("gt > 0"), 2).groupBy("case_id", F.col("place").cast("bigint").alias("place")).agg(F.count("*").alias("n"))


@query("medoids", ["fx_voxels"], f"""WITH {cc_sql('c', FG, OFF)}, m AS (SELECT n.case_id, comp, x, y, z FROM c JOIN c_n n ON n.id = c.id),
t AS (SELECT a.case_id, a.comp, a.x, a.y, a.z, round(sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))), 6) AS t FROM m a JOIN m b ON a.comp = b.comp GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY t, x, y, z) AS rn FROM t) SELECT case_id, x, y, z FROM r WHERE rn = 1""")
def medoids(v):
    return vol.medoids(v.where("gt > 0"), cap=200).select("case_id", "x", "y", "z")


@query("max_box", ["fx_boxes_gt"], "SELECT max(x1 - x0) AS dx, max(y1 - y0) AS dy, max(z1 - z0) AS dz FROM fx_boxes_gt")
def max_box(b):
    return b.agg(*[F.max(F.col(f"{c}1") - F.col(f"{c}0")).alias(f"d{c}") for c in "xyz"])


@query("seeded_split", ["customer"], """SELECT CASE WHEN n <= 10 THEN 'test' WHEN n <= 30 THEN 'validation' ELSE 'training' END AS split, count(*) AS n FROM (SELECT row_number() OVER () AS n FROM customer) q GROUP BY 1""")
def seeded_split(c):
    return vol.seeded_split(c.select(F.col("c_custkey").alias("id")), 0, 10, 20).groupBy("split").agg(F.count("*").alias("n"))


@query("ordered_split", ["documents"], """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id AS id, CASE WHEN p <= floor(n * 0.8) THEN 'training' WHEN p <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM r""")
def ordered_split(d):
    return vol.ordered_split(d.select(F.col("doc_id").alias("id")))


@query("listed_split", ["documents", "labels"], """SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 0 THEN 'validation' ELSE 'training' END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def listed_split(d, lab):
    lists = lab.where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "test").otherwise("validation").alias("split"))
    return vol.listed_split(d.select(F.col("doc_id").alias("id")), lists)


def _draw(k: int) -> str:
    v = f"((case_id * 31 + x * 7919 + y * 104729 + z * 1299709 + {k * 15485863}) % 1000003)"
    return f"(({v} * {v} + 7 * {v}) % 1000003)"


@query("patch_centres", ["fx_voxels"], f"""WITH n AS (SELECT case_id, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM fx_voxels GROUP BY case_id),
c AS (SELECT case_id, greatest(0, least(x + {_draw(8)} % 7 - 3, nx - 1)) AS cx, greatest(0, least(y + {_draw(9)} % 7 - 3, ny - 1)) AS cy, greatest(0, least(z + {_draw(10)} % 7 - 3, nz - 1)) AS cz
  FROM fx_voxels JOIN n USING (case_id) WHERE intensity > 0 AND {_draw(7)} % 20 = 0)
SELECT case_id, cx, cy, cz FROM c WHERE EXISTS (SELECT 1 FROM fx_voxels g WHERE gt > 0 AND g.case_id = c.case_id AND g.x >= cx - 2 AND g.x < cx + 2 AND g.y >= cy - 2 AND g.y < cy + 2 AND g.z >= cz - 2 AND g.z < cz + 2)""")
def patch_centres(v):
    return vol.patch_centres(v, extent(v), 3, seed=7, per=20, half=2)


@query("weighted_samples", ["fx_points"])
def weighted_samples(p):
    kind = F.when(F.col("vestype") == 0, "random").when(F.col("vestype") > 22, "raw").otherwise("labelled")
    return vol.weighted_samples(p.select("case_id", "trace_id", "seq", kind.alias("kind")), {"raw": 1, "labelled": 2, "random": 3}, seed=7)


@query("random_centres", ["fx_voxels"])
def random_centres(v):
    box = extent(v)
    for c, (lo, hi) in zip("xyz", ((2, 13), (3, 14), (1, 9))):
        box = box.withColumns({f"{c}0": F.when(F.col("nz") > 9, F.lit(lo)), f"{c}1": F.when(F.col("nz") > 9, F.lit(hi))})
    return vol.random_centres(box, 8, seed=7)


@query("augment", ["fx_voxels"], """WITH v AS (SELECT * FROM fx_voxels WHERE gt > 0), t AS (SELECT case_id, z, gt, 0 AS turn, x AS a, y AS b FROM v UNION ALL SELECT case_id, z, gt, 1, 15 - y, x FROM v UNION ALL SELECT case_id, z, gt, 2, 15 - x, 15 - y FROM v UNION ALL SELECT case_id, z, gt, 3, y, 15 - x FROM v)
SELECT case_id, z, gt, f AS flip, turn, CASE f WHEN 1 THEN 15 - a ELSE a END AS x, b AS y FROM t, (VALUES (0), (1)) f(f)""")
def augment(v):
    return vol.augment(v.where("gt > 0").select("case_id", "x", "y", "z", "gt"), (16, 16, 10))


@query("ensemble", ["lineitem"], """WITH m AS (SELECT l_orderkey, l_linenumber % 3 AS cls, avg(l_discount + 0.0) AS logit FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(logit, 9) DESC, cls) AS rn FROM m)
SELECT l_orderkey, cls, round(logit, 9) + 0.0 AS logit FROM r WHERE rn = 1""")
def ensemble(li):
    # Lines of an order stand for the logits of several models per class.
    out = li.select("l_orderkey", (F.col("l_linenumber") % 3).alias("cls"), (F.col("l_discount") + 0.0).alias("logit"))
    mean = out.groupBy("l_orderkey", "cls").agg(F.round(F.avg("logit"), 9).alias("logit"))
    return vol.ensemble(mean, ["l_orderkey"]).withColumn("logit", F.round("logit", 9) + 0.0)


def _conv_sql(kern, src="intensity"):
    rows = ", ".join(f"({a}, {b}, {c}, {w!r}::DOUBLE)" for (a, b, c), w in kern.items())
    return f"(SELECT v.case_id, v.x, v.y, v.z, sum(w * coalesce(n.{src}, 0)) AS conv FROM fx_voxels v CROSS JOIN (VALUES {rows}) k(a, b, c, w) LEFT JOIN fx_voxels n ON n.case_id = v.case_id AND n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c GROUP BY ALL)"


@query("laplacian", ["fx_voxels"], f"SELECT case_id, x, y, z, round(conv, 6) + 0.0 AS conv FROM {_conv_sql(vol.laplacian_kernel())} q")
def laplacian(v):
    return rounded(vol.convolve(v, vol.laplacian_kernel(), "intensity"), ["conv"])


@query("gradient", ["fx_voxels"], f"""SELECT a.case_id, a.x, a.y, a.z, round(sqrt(a.conv*a.conv + b.conv*b.conv + c.conv*c.conv + 1e-6), 6) AS gradient FROM {_conv_sql(vol.sobel_kernel(0))} a
JOIN {_conv_sql(vol.sobel_kernel(1))} b ON a.case_id = b.case_id AND a.x = b.x AND a.y = b.y AND a.z = b.z JOIN {_conv_sql(vol.sobel_kernel(2))} c ON a.case_id = c.case_id AND a.x = c.x AND a.y = c.y AND a.z = c.z""")
def gradient(v):
    return rounded(vol.gradient_magnitude(v, "intensity"), ["gradient"])


@query("soft_distance", ["fx_voxels"], """WITH o AS (SELECT a, b, c, exp(-sqrt(a*a + b*b + c*c) / 0.1) AS w FROM generate_series(-2, 2) ga(a), generate_series(-2, 2) gb(b), generate_series(-2, 2) gc(c)),
m AS (SELECT case_id, x, y, z, (gt > 0)::INT AS m FROM fx_voxels),
s AS (SELECT m.case_id, m.x, m.y, m.z, sum(n.m * w) AS conv FROM m CROSS JOIN o LEFT JOIN m n ON n.case_id = m.case_id AND n.x = m.x + a AND n.y = m.y + b AND n.z = m.z + c GROUP BY ALL)
SELECT case_id, x, y, z, round(-0.1 * ln(coalesce(conv, 0) + 1e-6), 6) + 0.0 AS soft FROM s""")
def soft_distance(v):
    m = v.select("case_id", "x", "y", "z", (F.col("gt") > 0).cast("double").alias("m"))
    return rounded(vol.soft_distance(m, "m"), ["soft"])


WIN = """w AS (SELECT v.*, greatest(0, ceil((nz - 4) / 2)) AS lw FROM fx_voxels v JOIN (SELECT case_id, max(z) + 1 AS nz FROM fx_voxels GROUP BY case_id) n ON v.case_id = n.case_id),
k AS (SELECT case_id, x, y, z, intensity, win, z - 2 * win AS rel_z, lw FROM w, generate_series(0, 4) g(win) WHERE win <= lw AND z >= 2 * win AND z < 2 * win + 4)"""


@query("depth_windows", ["fx_voxels"], f"WITH {WIN} SELECT case_id, x, y, z, win, rel_z, (rel_z >= 1 OR win = 0) AND (rel_z < 3 OR win = lw) AS core FROM k")
def depth_windows(v):
    return vol.depth_windows(v, 4, 1).select("case_id", "x", "y", "z", "win", "rel_z", "core")


@query("window_stitch", ["fx_voxels"], "SELECT case_id, x, y, z, intensity FROM fx_voxels")
def window_stitch(v):
    return vol.stitch(vol.depth_windows(v, 4, 1), "intensity")


@query("window_average", ["fx_voxels"], f"WITH {WIN} SELECT case_id, x, y, z, round(avg(intensity + rel_z), 6) AS m FROM k GROUP BY case_id, x, y, z")
def window_average(v):
    w = vol.depth_windows(v, 4, 1).withColumn("m", F.col("intensity") + F.col("rel_z"))
    return rounded(vol.overlap_average(w, "m"), ["m"])


@query("intensity_model", ["fx_voxels"], """SELECT case_id, round(avg(intensity) FILTER (WHERE gt > 0), 6) AS intensity_fg_mean, round(stddev_pop(intensity) FILTER (WHERE gt > 0), 6) AS intensity_fg_std, round(avg(intensity), 6) AS intensity_bg_mean, round(stddev_pop(intensity), 6) AS intensity_bg_std,
  round(avg(score) FILTER (WHERE gt > 0), 6) AS score_fg_mean, round(stddev_pop(score) FILTER (WHERE gt > 0), 6) AS score_fg_std, round(avg(score), 6) AS score_bg_mean, round(stddev_pop(score), 6) AS score_bg_std FROM fx_voxels GROUP BY case_id""")
def intensity_model(v):
    out = vol.intensity_model(v, v.where("gt > 0"), ["intensity", "score"])
    return rounded(out, [c for c in out.columns if c != "case_id"])


@query("intensity_match", ["fx_voxels"], """WITH s AS (SELECT case_id, z, avg(intensity) AS m, stddev_pop(intensity) AS s FROM fx_voxels GROUP BY case_id, z)
SELECT a.case_id, a.z, abs((b.m - a.m) / (0.1 * greatest(1, a.s))) <= 1.959963984540054 AS fits FROM s a JOIN s b ON a.case_id = b.case_id AND b.z = a.z + 1""")
def intensity_match(v):
    s = v.groupBy("case_id", "z").agg(F.avg("intensity").alias("a_mean"), F.stddev_pop("intensity").alias("a_std"))
    nxt = s.select("case_id", (F.col("z") - 1).alias("z"), F.col("a_mean").alias("b_mean"))
    both = s.join(nxt, ["case_id", "z"])
    return both.select("case_id", "z", vol.intensity_match(both, sigma=0.1).alias("fits"))


@query("path_posterior", ["fx_voxels"], """WITH q AS (SELECT case_id, gt > 0 AS fg, quantile_cont(intensity, 0.1) AS lo, quantile_cont(intensity, 0.9) AS hi, count(*) AS n FROM fx_voxels GROUP BY ALL),
s AS (SELECT v.case_id, fg, avg(intensity) AS m, greatest(1, stddev_pop(intensity)) AS s FROM fx_voxels v JOIN q ON q.case_id = v.case_id AND q.fg = (v.gt > 0) WHERE n < 10 OR intensity BETWEEN lo AND hi GROUP BY ALL),
d AS (SELECT v.case_id, v.x, v.y, v.z, exp(-pow(intensity - f.m, 2) / (2*f.s*f.s)) / (f.s * 2.5066282746310002) AS pf, exp(-pow(intensity - b.m, 2) / (2*b.s*b.s)) / (b.s * 2.5066282746310002) AS pb
  FROM fx_voxels v JOIN s f ON f.case_id = v.case_id AND f.fg JOIN s b ON b.case_id = v.case_id AND NOT b.fg)
SELECT case_id, x, y, z, round(pf / (pb + pf + 1e-6), 5) AS p FROM d""")
def path_posterior(v):
    v = v.withColumn("fg", F.col("gt") > 0)
    st = vol.weighted_stats(vol.trimmed(v, ["case_id", "fg"], "intensity"), ["case_id", "fg"], "intensity")
    f = st.where("fg").select("case_id", F.col("mean").alias("fm"), F.col("std").alias("fs"))
    b = st.where("not fg").select("case_id", F.col("mean").alias("bm"), F.col("std").alias("bs"))
    p = vol.path_posterior(F.col("intensity"), F.col("fm"), F.col("fs"), F.col("bm"), F.col("bs"))
    return v.join(f, "case_id").join(b, "case_id").select("case_id", "x", "y", "z", F.round(p, 5).alias("p"))


@query("class_entropy", ["embeddings"], """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), h AS (SELECT vec_id, list_sum(list_transform(e, lambda v: -(v / list_sum(e)) * log2(v / list_sum(e)))) / log2(len(e)) AS h FROM e)
SELECT vec_id, round(h, 6) AS entropy, round(avg(h) OVER (ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling FROM h""")
def class_entropy(e):
    from ..plans.blocks import framed

    ex = F.transform("embedding", lambda v: F.exp(v.cast("double")))
    p = e.select("vec_id", ex.alias("e")).withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    h = p.select("vec_id", vol.class_entropy(F.transform("e", lambda v: v / F.col("t"))).alias("entropy"))
    # vec_id counts 0, 1, 2, ... without gaps.
    out = framed(h, [], "vec_id", {"rolling": F.avg("entropy")}, 2, 0)
    return rounded(out, ["entropy", "rolling"])


@query("trace_priority", ["fx_points"], """WITH t AS (SELECT case_id, trace_id, round((max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z)), 6) AS box_volume, count(*) AS np FROM fx_points GROUP BY case_id, trace_id)
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY box_volume DESC, np DESC, trace_id) AS place FROM t""")
def trace_priority(p):
    from ..operators.editing import trace_priority as priority

    return priority(p)
