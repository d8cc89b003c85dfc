"""Trace files: one node per line, ``id type x y z rad pid``; seeds and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lookups import end_rule_table
from ..plans.blocks import BLOCK, running

NODE = [("id", "bigint"), ("type", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("rad", "double"), ("pid", "bigint")]


def case_of(path: Column) -> Column:
    """Case id from the file name: its text before the extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^/.]+)?$", 1)


def parse_nodes(lines: DataFrame) -> DataFrame:
    """``value`` lines to node columns; other columns stay."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(*[c for c in lines.columns if c != "value"], *[f[i].cast(t).alias(n) for i, (n, t) in enumerate(NODE)])


def scan_swc(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", case_of(F.col("_metadata.file_path")).alias("case_id"))
    return parse_nodes(lines.where("trim(value) <> '' and not value like '#%'"))


def to_traces(nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Number the traces of a case: a node with pid -1 starts one.  ``seq`` counts from 0."""
    t = running(nodes, ["case_id"], "id", {"trace_id": (F.col("pid") == -1).cast("bigint"), "_n": F.lit(1).cast("bigint")}, size=size)
    t = t.withColumn("trace_id", F.greatest(F.col("trace_id") - 1, F.lit(0)))
    first = t.groupBy("case_id", "trace_id").agg(F.min("_n").alias("_first"))
    # Nodes are counted, as ids may have gaps.
    return t.join(first, ["case_id", "trace_id"]).withColumn("seq", F.col("_n") - F.col("_first")).drop("_first", "_n")


def vessel_types(traces: DataFrame) -> DataFrame:
    """Vessel type of each trace from the types of its ends; 0 if no rule fits."""
    rules = F.broadcast(end_rule_table(traces.sparkSession))  # a fixed table
    e = traces.groupBy("case_id", "trace_id").agg(F.min_by("type", "seq").alias("start_type"), F.max_by("type", "seq").alias("end_type"), F.count("*").alias("np"))
    return e.join(rules, ["start_type", "end_type"], "left").withColumn("vestype", F.coalesce("vestype", F.lit(0)))


def vessel_segments(nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Nodes with their vessel: 1st to 2nd typed node, 3rd to 4th, ...; an open last one is dropped."""
    typed = (F.col("type") != 0).cast("bigint")
    s = running(nodes, ["case_id"], "id", {"_n": typed}, size=size).withColumn("segment", F.floor((F.col("_n") - typed) / 2)).drop("_n")
    ok = s.groupBy("case_id", "segment").agg(
        F.count_if(F.col("type") != 0).alias("_c"), F.min(F.when(F.col("type") != 0, F.struct("id", "type"))).alias("_a"), F.max(F.when(F.col("type") != 0, F.struct("id", "type"))).alias("_b")
    ).where("_c = 2").select("case_id", "segment", F.col("_a.type").alias("start_type"), F.col("_b.type").alias("end_type"))
    rules = F.broadcast(end_rule_table(nodes.sparkSession))
    return s.join(ok.join(rules, ["start_type", "end_type"], "left").withColumn("vestype", F.coalesce("vestype", F.lit(0))), ["case_id", "segment"])


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes at one position share the first id; parents follow; ``degree`` = distinct neighbours."""
    uid = nodes.groupBy("case_id", "x", "y", "z").agg(F.min("id").alias("uid"))
    n = nodes.join(uid, ["case_id", "x", "y", "z"])
    parent = n.select("case_id", F.col("id").alias("pid"), F.col("uid").alias("upid"))
    n = n.join(parent, ["case_id", "pid"], "left").withColumn("upid", F.coalesce("upid", F.lit(-1)))
    arcs = n.where("upid <> -1").select("case_id", F.col("uid").alias("a"), F.col("upid").alias("b"))
    both = arcs.unionByName(arcs.select("case_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    deg = both.groupBy("case_id", F.col("a").alias("uid")).agg(F.count("*").alias("degree"))
    return n.join(deg, ["case_id", "uid"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def swc_lines(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """Lines of a trace file: traces below 3 nodes skipped, ids from 1 per case, (case_id, id, value)."""
    np_ = points.groupBy("case_id", "trace_id").agg(F.count("*").alias("_np")).where("_np >= 3")
    shift = running(np_, ["case_id"], "trace_id", {"_to": F.col("_np")}, size=size).select("case_id", "trace_id", (F.col("_to") - F.col("_np")).alias("_shift"))
    p = points.join(shift, ["case_id", "trace_id"]).withColumn("id", F.col("_shift") + F.col("seq") + 1)
    kind = F.coalesce(F.col("node_type"), F.lit(0)).cast("int") if "node_type" in points.columns else F.lit(0)
    pid = F.when(F.col("seq") == 0, F.lit(-1)).otherwise(F.col("id") - 1)
    return p.select("case_id", "id", F.format_string("%d %d %.3f %.3f %.3f %.3f %d", "id", kind, "x", "y", "z", "rad", pid.cast("bigint")).alias("value"))


def write_swc(points: DataFrame, path: str) -> None:
    """One folder per case; lines in id order inside range-partitioned files."""
    lines = swc_lines(points).repartitionByRange("case_id", "id").sortWithinPartitions("case_id", "id")
    lines.select("case_id", "value").write.partitionBy("case_id").text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    return parse_nodes(spark.read.text(path))


def parse_seeds(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of three numbers, and the lines that are not."""
    f = F.split(F.trim("value"), r"\s+")
    good = (F.size(f) == 3) & f[0].try_cast("double").isNotNull() & f[1].try_cast("double").isNotNull() & f[2].try_cast("double").isNotNull()
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(good).select(*rest, *[f[i].try_cast("double").alias(c) for i, c in enumerate("xyz")]), lines.where(~good)


def seed_lines(seeds: DataFrame) -> DataFrame:
    return seeds.select("case_id", F.format_string("%.3f %.3f %.3f", "x", "y", "z").alias("value"))


def scan_notes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated notes: position in the first three columns, note, then the category last."""
    raw = spark.read.text(path)
    f = F.split("value", "\t")
    return raw.where(F.size(f) >= 4).select(
        case_of(F.col("_metadata.file_path")).alias("case_id"), *[f[i].cast("double").alias(c) for i, c in enumerate("xyz")], f[3].alias("note"), F.element_at(f, -1).alias("cat")
    )
