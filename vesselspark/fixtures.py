"""Inputs of the domain's shape, derived from the given tables.

Each input exists twice: as DataFrame code, which cuts every ordered step into
blocks, and as SQL text for the reference engine.  Spark writes each derived table
once per session and input folder, as a cohort's point and voxel tables would be
stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.blocks import running
from .session import stored

SQL = {
    "fx_points": """
SELECT case_id, trace_id, seq, ev, event_type,
       CAST(40 AS DOUBLE) + CAST(sx AS DOUBLE) / 2 AS x,
       CAST(40 AS DOUBLE) + CAST(sy AS DOUBLE) / 2 AS y,
       CAST(40 AS DOUBLE) + CAST(sz AS DOUBLE) / 2 AS z,
       CAST(0.5 AS DOUBLE) + CAST(ev % 30 AS DOUBLE) / 10 AS rad,
       trace_id % 25 AS vestype
FROM (
  SELECT CAST(floor(CAST(user_id AS DOUBLE) / 20) AS BIGINT) AS case_id, user_id AS trace_id, event_id AS ev,
    event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS seq,
    SUM((event_id * 7919 % 1009) % 5 - 2)   OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sx,
    SUM((event_id * 104729 % 1013) % 5 - 2) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sy,
    SUM((event_id * 15485863 % 1019) % 5 - 2) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sz
  FROM events) t""",
    "fx_swc": """
SELECT case_id, id, type, x, y, z, rad, CASE WHEN seq = 0 THEN -1 ELSE id - 1 END AS pid
FROM (
  SELECT p.*, row_number() OVER (PARTITION BY case_id ORDER BY trace_id, seq) AS id,
         CASE WHEN seq = 0 OR seq = last_seq THEN 1 + (trace_id + seq) % 22 ELSE 0 END AS type
  FROM (SELECT f.*, MAX(seq) OVER (PARTITION BY trace_id) AS last_seq FROM fx_points f) p) q""",
    "fx_landmarks": """
SELECT case_id, 1 + trace_id % 22 AS lm_type, x, y, z FROM fx_points WHERE seq = 0""",
    "fx_voxels": """
SELECT case_id, x, y, z, MAX(l_quantity) AS intensity,
       MAX(CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 1 + l_suppkey % 3 ELSE 0 END) AS gt,
       MAX(CASE WHEN l_linestatus = 'O' AND l_quantity > 30 THEN 1 + l_suppkey % 3 ELSE 0 END) AS pred,
       MAX(l_quantity) / 50 AS score
FROM (
  SELECT l.*, 8 * CAST(floor(CAST(l_orderkey AS DOUBLE) / 4096) AS BIGINT) + l_linenumber AS case_id,
         l_partkey % 16 AS x, CAST(floor(CAST(l_partkey AS DOUBLE) / 16) AS BIGINT) % 16 AS y, l_suppkey % 10 AS z
  FROM lineitem l) t
GROUP BY case_id, x, y, z""",
    "fx_boxes_gt": """
SELECT p_partkey AS box_id, CAST(floor(CAST(p_partkey AS DOUBLE) / 20) AS BIGINT) AS image_id, p_partkey % 2 AS cls,
       p_partkey % 50 AS x0, p_partkey % 30 AS y0, p_partkey % 20 AS z0,
       p_partkey % 50 + 20 + p_size AS x1, p_partkey % 30 + 20 + p_size AS y1, p_partkey % 20 + 10 + p_size AS z1
FROM part""",
    "fx_boxes_pred": """
SELECT p_partkey AS box_id, CAST(floor(CAST(p_partkey AS DOUBLE) / 20) AS BIGINT) AS image_id, p_partkey % 2 AS cls,
       p_retailprice / 2000 AS score,
       p_partkey % 50 + p_size % 9 AS x0, p_partkey % 30 + p_size % 5 AS y0, p_partkey % 20 + p_size % 4 AS z0,
       p_partkey % 50 + 22 + p_size AS x1, p_partkey % 30 + 21 + p_size AS y1, p_partkey % 20 + 12 + p_size AS z1
FROM part""",
    "fx_scores": """
SELECT l.doc_id, d.source AS case_id, CAST(floor(CAST(l.doc_id AS DOUBLE) / 10) AS BIGINT) AS slice_id,
       l.quality AS y, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS score, l.toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "fx_meta": """
SELECT p_partkey AS idx,
       CASE WHEN p_partkey % 4 = 0 THEN '[-1]' ELSE concat('[', CAST(p_size AS VARCHAR(20)), ', ', CAST(p_size + 9 AS VARCHAR(20)),
         ', 3, 12, ', CAST(p_size % 7 AS VARCHAR(20)), ', ', CAST(p_size % 7 + 5 AS VARCHAR(20)), ']') END AS pos_s,
       concat('(0.', CAST(25 + p_size % 50 AS VARCHAR(20)), ', 0.3, 0.6)') AS spacing
FROM part""",
}
# A second tracing: cut every 40 points, shifted in x.  Events of type 'error' are missed.
SQL["fx_pred_points"] = """
SELECT case_id, 100000 * (1 + trace_id) + CAST(floor(CAST(n AS DOUBLE) / 40) AS BIGINT) AS trace_id,
       n - 40 * CAST(floor(CAST(n AS DOUBLE) / 40) AS BIGINT) AS seq,
       x + CAST(ev % 4 AS DOUBLE) / 4 AS x, y, z, rad
FROM (SELECT f.*, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS n
      FROM fx_points f WHERE event_type <> 'error') g"""

NEEDS = {"fx_swc": ["fx_points"], "fx_pred_points": ["fx_points"], "fx_landmarks": ["fx_points"]}

_done: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(prime: int, modulus: int):
        return (F.col("event_id") * prime) % modulus % 5 - 2

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    walk = running(
        ev,
        ["user_id"],
        "ts",
        {"n": F.lit(1).cast("bigint"), "sx": step(7919, 1009), "sy": step(104729, 1013), "sz": step(15485863, 1019)},
        block=F.to_date("ts"),
    )
    at = {c: F.lit(40.0) + F.col(f"s{c}").cast("double") / 2 for c in "xyz"}
    return walk.select(
        F.floor(F.col("user_id") / 20).alias("case_id"),
        F.col("user_id").alias("trace_id"),
        (F.col("n") - 1).alias("seq"),
        F.col("event_id").alias("ev"),
        "event_type",
        *[e.alias(c) for c, e in at.items()],
        (F.lit(0.5) + (F.col("event_id") % 30).cast("double") / 10).alias("rad"),
        (F.col("user_id") % 25).alias("vestype"),
    )


def _swc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = get(spark, sf_dir, "fx_points")
    size = p.groupBy("case_id", "trace_id").agg(F.count("*").alias("_np"))
    # Node ids run on over the traces of a case: offset of the trace + position in it.
    first = running(
        size, ["case_id"], "trace_id", {"_before": F.col("_np")}, block=F.floor(F.col("trace_id") / 65536)
    ).select("case_id", "trace_id", "_np", (F.col("_before") - F.col("_np")).alias("_shift"))
    node = p.join(first, ["case_id", "trace_id"]).withColumn("id", F.col("_shift") + F.col("seq") + 1)
    ends = (F.col("seq") == 0) | (F.col("seq") == F.col("_np") - 1)
    return node.select(
        "case_id",
        "id",
        F.when(ends, 1 + (F.col("trace_id") + F.col("seq")) % 22).otherwise(F.lit(0)).alias("type"),
        "x", "y", "z", "rad",
        F.when(F.col("seq") == 0, F.lit(-1)).otherwise(F.col("id") - 1).alias("pid"),
    )


def _pred_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = get(spark, sf_dir, "fx_points").where("event_type <> 'error'")
    kept = running(p, ["trace_id"], "seq", {"_n": F.lit(1).cast("bigint")}).withColumn("_n", F.col("_n") - 1)
    part = F.floor(F.col("_n") / 40)
    return kept.select(
        "case_id",
        (100000 * (1 + F.col("trace_id")) + part).alias("trace_id"),
        (F.col("_n") - 40 * part).alias("seq"),
        (F.col("x") + (F.col("ev") % 4).cast("double") / 4).alias("x"),
        "y", "z", "rad",
    )


def _from_sql(name: str):
    """Inputs without an ordered step need no blocks: their SQL runs as it is."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        for base in ("lineitem", "part", "labels", "documents"):
            if f" {base} " in f" {SQL[name]} ".replace("\n", " "):
                table(spark, sf_dir, base).createOrReplaceTempView(base)
        for need in NEEDS.get(name, []):
            get(spark, sf_dir, need).createOrReplaceTempView(need)
        return spark.sql(SQL[name])

    return build


_build = {name: _from_sql(name) for name in SQL}
_build.update(fx_points=_points, fx_swc=_swc, fx_pred_points=_pred_points)


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _done:
        _done[key] = stored(_build[name](spark, sf_dir), name)
    return _done[key]


def with_views(views: list[str], body: str) -> str:
    """Put the SQL of the named inputs in front of a query (``WITH``-less CTEs first)."""
    order: list[str] = []

    def add(v: str) -> None:
        for need in NEEDS.get(v, []):
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({SQL[v]})" for v in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:].strip())
        return "WITH RECURSIVE " + ",\n".join(parts)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
