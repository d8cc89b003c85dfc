"""Scans and sinks, run over lines derived from the given tables."""

from pyspark.sql import functions as F

from ..functions.lookups import end_rules, sql_values
from ..sources import settings as st, swc, tables as tb
from . import query
from .features import rounded

RULES = f"rules(a, b, v) AS (VALUES {sql_values(end_rules())})"


@query("swc_scan_traces", ["fx_swc"], f"""WITH {RULES}, t AS (SELECT *, sum((pid = -1)::INT) OVER (PARTITION BY case_id ORDER BY id ROWS UNBOUNDED PRECEDING) - 1 AS trace_id FROM fx_swc),
e AS (SELECT case_id, CAST(trace_id AS BIGINT) AS trace_id, arg_min(type, id) AS a, arg_max(type, id) AS b, count(*) AS np FROM t GROUP BY ALL)
SELECT case_id, trace_id, np, coalesce(v, 0) AS vestype FROM e LEFT JOIN rules USING (a, b)""")
def swc_scan_traces(nodes):
    # Through the text form and back, as a file would be read.
    line = F.concat_ws(" ", "id", "type", "x", "y", "z", "rad", "pid")
    back = swc.parse_nodes(nodes.select("case_id", line.alias("value")))
    return swc.vessel_types(swc.to_traces(back)).select("case_id", "trace_id", "np", "vestype")


@query("swc_gappy_ids", ["fx_swc"], """WITH t AS (SELECT case_id, 3 * id AS id, x, sum((pid = -1)::INT) OVER (PARTITION BY case_id ORDER BY id ROWS UNBOUNDED PRECEDING) - 1 AS trace_id FROM fx_swc)
SELECT case_id, id, CAST(trace_id AS BIGINT) AS trace_id, row_number() OVER (PARTITION BY case_id, trace_id ORDER BY id) - 1 AS seq FROM t""")
def swc_gappy_ids(nodes):
    gaps = nodes.withColumns({"id": F.col("id") * 3, "pid": F.when(F.col("pid") == -1, F.col("pid")).otherwise(F.col("pid") * 3)})
    return swc.to_traces(gaps).select("case_id", "id", "trace_id", "seq")


@query("vessel_segments", ["fx_swc"], f"""WITH {RULES}, s AS (SELECT *, CAST(floor((sum((type <> 0)::INT) OVER (PARTITION BY case_id ORDER BY id ROWS UNBOUNDED PRECEDING) - (type <> 0)::INT) / 2) AS BIGINT) AS segment FROM fx_swc),
g AS (SELECT case_id, segment, arg_min(type, id) FILTER (WHERE type <> 0) AS a, arg_max(type, id) FILTER (WHERE type <> 0) AS b, count(*) AS np FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE type <> 0) = 2)
SELECT case_id, segment, coalesce(v, 0) AS vestype, np FROM g LEFT JOIN rules USING (a, b)""")
def vessel_segments(nodes):
    return swc.vessel_segments(nodes).groupBy("case_id", "segment", "vestype").agg(F.count("*").alias("np"))


@query("unique_nodes", ["fx_swc"], """WITH u AS (SELECT *, min(id) OVER (PARTITION BY case_id, x, y, z) AS uid FROM fx_swc), p AS (SELECT a.*, coalesce(b.uid, -1) AS upid FROM u a LEFT JOIN u b ON a.case_id = b.case_id AND a.pid = b.id),
r AS (SELECT DISTINCT case_id, uid AS a, upid AS b FROM p WHERE upid <> -1 UNION SELECT case_id, upid, uid FROM p WHERE upid <> -1), d AS (SELECT case_id, a, count(*) AS degree FROM r GROUP BY ALL)
SELECT p.case_id, p.id, uid, upid, coalesce(degree, 0) AS degree FROM p LEFT JOIN d ON d.case_id = p.case_id AND d.a = p.uid""")
def unique_nodes(nodes):
    return swc.unique_nodes(nodes).select("case_id", "id", "uid", "upid", "degree")


@query("swc_lines", ["fx_points"], """WITH k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY case_id, trace_id) AS np FROM fx_points) q WHERE np >= 3), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY trace_id, seq) AS id FROM k)
SELECT case_id, id, printf('%d 0 %.3f %.3f %.3f %.3f %d', id, x, y, z, rad, CASE WHEN seq = 0 THEN -1 ELSE id - 1 END) AS "value" FROM n""")
def swc_lines(p):
    return swc.swc_lines(p)


SEED = "CASE WHEN event_type = 'error' THEN concat(CAST(seq AS VARCHAR), ' bad') ELSE printf('%.3f %.3f %.3f', x, y, z) END"


@query("seed_scan", ["fx_points"], "SELECT case_id, 'good' AS state, count(*) AS n, round(sum(x + y + z), 3) AS total FROM fx_points WHERE event_type <> 'error' GROUP BY case_id UNION ALL SELECT case_id, 'rejected', count(*), NULL FROM fx_points WHERE event_type = 'error' GROUP BY case_id")
def seed_scan(p):
    bad = p.where("event_type = 'error'").select("case_id", F.concat(F.col("seq").cast("string"), F.lit(" bad")).alias("value"))
    good, rejected = swc.parse_seeds(swc.seed_lines(p.where("event_type <> 'error'")).unionByName(bad))
    a = good.groupBy("case_id").agg(F.lit("good").alias("state"), F.count("*").alias("n"), F.round(F.sum(F.col("x") + F.col("y") + F.col("z")), 3).alias("total"))
    b = rejected.groupBy("case_id").agg(F.lit("rejected").alias("state"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return a.unionByName(b)


@query("meta_parse", ["fx_meta"], """SELECT idx, CASE WHEN pos_s <> '[-1]' THEN list_transform(string_split(trim(pos_s, '[]'), ', '), lambda s: CAST(s AS INT)) END AS pos_s,
  list_transform(string_split(trim(spacing, '()'), ', '), lambda s: CAST(s AS DOUBLE)) AS spacing FROM fx_meta""")
def meta_parse(m):
    return tb.parse_meta(m)


EXTRA = "concat('[', replace(trim(pos_s, '[]'), ', ', ' '), '],[', array_to_string(list_transform(string_split(trim(spacing, '()'), ', '), lambda s: CAST(CAST(s AS DOUBLE) AS VARCHAR)), ' '), ']')"


@query("extra_parse", ["fx_meta"], f"""SELECT idx, {EXTRA} AS extra, CASE WHEN pos_s <> '[-1]' THEN list_transform(string_split(trim(pos_s, '[]'), ', '), lambda s: CAST(s AS INT)) END AS box,
  list_transform(string_split(trim(spacing, '()'), ', '), lambda s: CAST(s AS DOUBLE)) AS spacing FROM fx_meta""")
def extra_parse(m):
    parsed = tb.parse_meta(m)
    e = parsed.select("idx", tb.format_extra(F.col("pos_s"), F.col("spacing")).alias("extra"))
    box, spacing = tb.parse_extra(F.col("extra"))
    return e.select("idx", "extra", box.alias("box"), spacing.alias("spacing"))


@query("manifest", ["documents", "labels"], """WITH s AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 0 THEN 'validation' ELSE 'training' END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT split, concat('imagesTr/', lpad(CAST(doc_id AS VARCHAR), 6, '0'), '.nii.gz') AS image, count(*) OVER (PARTITION BY split) AS n FROM s""")
def manifest(d, lab):
    from .volumes import listed_split

    entries = listed_split(d, lab).withColumn("image", F.concat(F.lit("imagesTr/"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".nii.gz")))
    text = tb.manifest(entries, "cohort", {0: "background", 1: "artery"})
    head = text.where("section = 0").select(F.from_json(F.regexp_replace("value", ",$", "}"), "numTest bigint, numValidation bigint, numTraining bigint").alias("h")).select("h.*")
    n = F.create_map(F.lit("test"), F.col("numTest"), F.lit("validation"), F.col("numValidation"), F.lit("training"), F.col("numTraining"))
    counts = head.select(F.explode(n).alias("split", "n"))
    body = text.where("section > 0 and place > 0 and value like '{%'")
    return body.select("split", F.from_json(F.regexp_replace("value", ",$", ""), "image string").alias("e")).select("split", "e.image").join(counts, "split")


@query("box_text", ["fx_boxes_gt"], "SELECT box_id AS case_id, x0, y0, z0, x1, y1, z1 FROM fx_boxes_gt")
def box_text(b):
    text = F.concat(
        F.lit("box\nsize: "), F.concat_ws(" ", *[(F.col(f"{c}1") - F.col(f"{c}0") + 0.25).cast("string") for c in "xyz"]),
        F.lit("\nlocation: "), F.concat_ws(" ", *[(F.col(f"{c}0") + 0.5).cast("string") for c in "xyz"]),
    )
    return tb.parse_box_text(b.select(F.col("box_id").alias("case_id"), text.alias("value")))


@query("slice_boxes", ["fx_boxes_pred"], """SELECT image_id AS slice_no, box_id, (x0 + x1) / 2 AS bx, (y0 + y1) / 2 AS "by", CAST(x1 - x0 AS DOUBLE) AS bw, CAST(y1 - y0 AS DOUBLE) AS bh, round(score, 6) AS conf,
  [CASE WHEN cls = 0 THEN round(score, 6) ELSE 0 END, CASE WHEN cls = 1 THEN round(score, 6) ELSE 0 END] AS scores FROM fx_boxes_pred""")
def slice_boxes(b):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")], F.round("score", 6).cast("string"), F.col("cls").cast("string"))
    return tb.parse_slice_boxes(b.select(F.col("image_id").alias("slice_no"), "box_id", line.alias("value")), 2)


@query("source_inventory", ["documents"], """SELECT concat('c', CAST(CAST(floor(doc_id / 4) AS BIGINT) AS VARCHAR)) AS case_id, bool_or(lang = 'en') AS o, bool_or(lang = 'de') AS v, bool_or(lang = 'fr') AS s FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY 1""")
def source_inventory(d):
    src = F.when(F.col("lang") == "en", "o").when(F.col("lang") == "de", "v").when(F.col("lang") == "fr", "s").otherwise("zz")
    path = F.concat(F.lit("/data/c"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("_"), src, F.lit(".tif"))
    return tb.inventory(d.select(path.alias("path")), ["o", "v", "s"])


@query("check_pairs", ["documents", "labels"], """SELECT coalesce(d.c, l.c) AS case_id, CASE WHEN d.c IS NULL THEN 'no image' WHEN l.c IS NULL THEN 'no label' ELSE 'ok' END AS state
FROM (SELECT DISTINCT doc_id AS c FROM documents WHERE lang <> 'en') d FULL JOIN (SELECT DISTINCT doc_id AS c FROM labels) l ON d.c = l.c""")
def check_pairs(d, lab):
    return tb.check_pairs(d.where("lang <> 'en'").select(F.col("doc_id").alias("case_id")), lab.select(F.col("doc_id").alias("case_id")))


@query("copy_plan", ["documents", "labels"], """SELECT doc_id AS case_id, source AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND lang <> 'en'""")
def copy_plan(d, lab):
    files = d.select(F.col("doc_id").alias("case_id"), F.col("source").alias("name"))
    have = d.where("lang = 'en'").select(F.col("doc_id").alias("case_id"), F.col("source").alias("name"))
    return tb.copy_plan(files, have, lab.select(F.col("doc_id").alias("case_id")))


@query("vessel_image", ["fx_voxels", "nation"], "SELECT case_id, x, y, z, coalesce(n_regionkey, 0) AS vestype FROM fx_voxels LEFT JOIN nation ON n_nationkey = gt")
def vessel_image(v, n):
    painted = v.select("case_id", "x", "y", "z", F.col("gt").alias("v"))
    return tb.vessel_id_image(painted, n.select(F.col("n_nationkey").alias("painted_id"), F.col("n_regionkey").alias("vestype"))).drop("v")


@query("case_metrics_text", ["embeddings"], """SELECT concat('case', CAST(vec_id AS VARCHAR)) AS case_id, concat('m', CAST(unnest(generate_series(1, len(embedding))) AS VARCHAR)) AS name, unnest(list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 4))) AS metric FROM embeddings""")
def case_metrics_text(e):
    item = lambda v, i: F.concat(F.lit("'m"), (i + 1).cast("string"), F.lit("': "), F.round(v.cast("double"), 4).cast("string"))
    ids = e.select((F.col("vec_id") * 2).alias("n"), F.concat(F.lit("case"), F.col("vec_id").cast("string")).alias("value"))
    body = e.select((F.col("vec_id") * 2 + 1).alias("n"), F.concat(F.lit("{"), F.array_join(F.transform("embedding", item), ", "), F.lit("}")).alias("value"))
    return tb.parse_case_metrics(ids.unionByName(body))


@query("upsert", ["fx_landmarks", "fx_points"], """WITH n AS (SELECT case_id, 1 + vestype % 22 AS lm_type, max(x) AS x, max(y) AS y, max(z) AS z FROM fx_points WHERE vestype < 6 GROUP BY ALL)
SELECT * FROM fx_landmarks l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.case_id = l.case_id AND n.lm_type = l.lm_type) UNION ALL SELECT * FROM n""")
def upsert(lm, p):
    new = p.where("vestype < 6").groupBy("case_id", (1 + F.col("vestype") % 22).alias("lm_type")).agg(*[F.max(c).alias(c) for c in "xyz"])
    return tb.upsert(lm, new, ["case_id", "lm_type"])


def contours(p):
    """Traces as closed contours: the trace is the slice, radius the distance from the centre."""
    from .points import polar_contour

    inner = polar_contour(p).select("case_id", F.col("trace_id").alias("slice_no"), F.lit("Lumen").alias("kind"), "seq", "px", "py")
    outer = inner.withColumns({"kind": F.lit("Outer Wall"), "px": 64 + (F.col("px") - 64) * 2, "py": 60 + (F.col("py") - 60) * 2})
    return inner.unionByName(outer)


CONT = """n AS (SELECT *, count(*) OVER (PARTITION BY case_id, trace_id) AS n FROM fx_points), i AS (SELECT case_id, trace_id AS slice_no, 'Lumen' AS kind, seq, round(64 + rad * cos(radians(360.0 / n * seq)), 6) AS px, round(60 + rad * sin(radians(360.0 / n * seq)), 6) AS py FROM n),
c AS (SELECT * FROM i UNION ALL SELECT case_id, slice_no, 'Outer Wall', seq, 64 + (px - 64) * 2, 60 + (py - 60) * 2 FROM i)"""


@query("contour_area", ["fx_points"], f"""WITH {CONT}, l AS (SELECT *, coalesce(lead(px) OVER w, first_value(px) OVER w) AS nx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS ny FROM c WINDOW w AS (PARTITION BY case_id, slice_no, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT case_id, slice_no, kind, round(abs(sum(px * ny - nx * py)) / 2, 5) AS area FROM l GROUP BY ALL""")
def contour_area(p):
    return rounded(st.contour_area(contours(p)), ["area"], 5)


@query("wall_measures", ["fx_points"], f"""WITH {CONT}, d AS (SELECT o.case_id, o.slice_no, o.seq, min(sqrt((o.px-i.px)*(o.px-i.px) + (o.py-i.py)*(o.py-i.py))) AS d FROM c o JOIN c i ON o.case_id = i.case_id AND o.slice_no = i.slice_no AND o.kind = 'Outer Wall' AND i.kind = 'Lumen' GROUP BY ALL)
SELECT case_id, slice_no, round(max(d), 5) AS max_thick, round(min(d), 5) AS min_thick, round(avg(d), 5) AS avg_thick, round(stddev_pop(d), 5) AS std_thick FROM d GROUP BY ALL""")
def wall_measures(p):
    return rounded(st.wall_measures(contours(p)), ["max_thick", "min_thick", "avg_thick", "std_thick"], 5).drop("lumen_area", "wall_area")


@query("contour_points", ["fx_points"], f"""WITH {CONT}, s AS (SELECT case_id, slice_no, kind, count(*) // 6 AS s FROM c GROUP BY ALL)
SELECT c.case_id, c.slice_no, c.kind, i, c.seq, round((px / 4 + 64 - 64.0) / 128 * 512, 5) AS px, round((py / 4 + 64 - 64.0) / 128 * 512, 5) AS "py" FROM s, generate_series(0, 5) g(i), c WHERE c.case_id = s.case_id AND c.slice_no = s.slice_no AND c.kind = s.kind AND c.seq = s.s * i""")
def contour_points(p):
    out = st.control_points(st.contour_to_image(contours(p), 128))
    return out.select("case_id", "slice_no", "kind", F.col("i").cast("bigint").alias("i"), "seq", "px", "py")


@query("contour_consistency", ["fx_points"], """WITH s AS (SELECT case_id, trace_id, CAST(floor(seq / 4) AS BIGINT) AS i, stddev_pop(rad) AS s, avg(rad) AS m FROM fx_points GROUP BY ALL)
SELECT case_id, trace_id AS slice_no, 'Lumen' AS kind, round(1 - avg(s * sqrt(12)), 9) AS consistency, round(avg(m), 9) AS mean_rho FROM s GROUP BY ALL""")
def contour_consistency(p):
    rot = p.select("case_id", F.col("trace_id").alias("slice_no"), F.lit("Lumen").alias("kind"), F.floor(F.col("seq") / 4).alias("i"), (F.col("seq") % 4).alias("rotation"), F.col("rad").alias("rho"))
    return rounded(st.contour_consistency(rot), ["consistency", "mean_rho"], 9)


@query("slice_quality", ["lineitem"], """WITH q AS (SELECT l_linenumber AS case_id, CAST(l_quantity AS INT) - 60 AS idx, CAST(max(l_suppkey) % 5 AS INT) AS iq FROM lineitem GROUP BY ALL), f AS (SELECT case_id, min(idx) AS first FROM q GROUP BY case_id), s AS (SELECT DISTINCT l_linenumber AS case_id, CAST(l_quantity AS INT) * 2 AS slice_no FROM lineitem)
SELECT s.case_id, slice_no, coalesce(iq, 0) AS iq FROM s JOIN f ON s.case_id = f.case_id LEFT JOIN q ON q.case_id = s.case_id AND q.idx = slice_no - (30 - (-1 - first)) + first""")
def slice_quality(li):
    n = F.col("l_quantity").cast("int")
    q = li.groupBy(F.col("l_linenumber").alias("case_id"), (n - 60).alias("idx")).agg((F.max("l_suppkey") % 5).cast("int").alias("iq"))
    slices = li.select(F.col("l_linenumber").alias("case_id"), (n * 2).alias("slice_no")).distinct()
    bif = slices.select("case_id", F.lit(30).alias("bif")).distinct()
    return st.quality_at(q, bif, slices)
