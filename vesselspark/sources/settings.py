"""Settings and contour XML, read with the built-in XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.points import RTM
from ..plans.blocks import neighbours
from .swc import case_of


def scan_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    raw = spark.read.format("xml").options(rowTag=row, attributePrefix="_").schema(schema).load(path)
    return raw.select(case_of(F.col("_metadata.file_path")).alias("case_id"), *raw.columns)


def scan_landmarks(spark: SparkSession, path: str, ignore_outer: bool = False) -> DataFrame:
    """Typed positions; ``ignore_outer`` leaves types 13 and 14 out."""
    p = scan_xml(spark, path, "Point", "type int, location string")
    at = F.split("location", ",").cast("array<double>")
    out = p.select("case_id", F.col("type").alias("lm_type"), *[at[i].alias(c) for i, c in enumerate("xyz")])
    return out.where("lm_type not in (13, 14)") if ignore_outer else out


def landmarks_of(landmarks: DataFrame, lm_type: int, one: bool = False) -> DataFrame:
    hit = landmarks.where(F.col("lm_type") == lm_type)
    return hit.groupBy("case_id", "lm_type").agg(F.min(F.struct("x", "y", "z")).alias("p")).select("case_id", "lm_type", "p.*") if one else hit


SETTINGS = (
    "CROP struct<item0:int,item1:int,item2:int,item3:int>, Resolution struct<Res:double>, "
    "VWSeg struct<Seg:array<struct<Snakeid:string,Start:int,End:int,vwids:string,QVSPath:string>>>, "
    "SeqRTM struct<Seq:array<struct<Seqname:string," + ",".join(f"R{i}:double" for i in range(1, 10)) + ",T1:double,T2:double,T3:double>>>"
)


def scan_settings(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Crop region (0, 0, -1, -1 by default) and resolution of every case."""
    s = scan_xml(spark, path, row, SETTINGS)
    crop = [F.coalesce(F.col(f"CROP.item{i}"), F.lit(d)).alias(n) for i, (n, d) in enumerate((("x_min", 0), ("y_min", 0), ("x_max", -1), ("y_max", -1)))]
    return s.select("case_id", *crop, F.col("Resolution.Res").alias("res"))


def wall_segments(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Wall-segment ranges with the first slice of ``vwids`` ("point:slice,...")."""
    s = scan_xml(spark, path, row, SETTINGS)
    seg = s.select("case_id", F.explode("VWSeg.Seg").alias("s"))
    first = F.regexp_extract("s.vwids", r"^[^:,]*:([^,]*)", 1).cast("int")
    return seg.select("case_id", F.col("s.Snakeid").alias("trace_id"), F.col("s.Start").alias("start"), F.col("s.End").alias("end"), first.alias("slice_no"), F.col("s.QVSPath").alias("path"))


def scan_transforms(spark: SparkSession, path: str, row: str) -> DataFrame:
    s = scan_xml(spark, path, row, SETTINGS).select("case_id", F.explode("SeqRTM.Seq").alias("s"))
    names = [*[f"R{i}" for i in range(1, 10)], "T1", "T2", "T3"]
    return s.select("case_id", F.col("s.Seqname").alias("seq_name"), *[F.col(f"s.{n}").alias(c) for n, c in zip(names, RTM)])


def transform_for(cases: DataFrame, transforms: DataFrame, seq_name: str, strict: bool = True) -> DataFrame:
    """Transform of a sequence per case; absent: an error if ``strict``, else the identity."""
    t = transforms.where(F.col("seq_name") == seq_name).drop("seq_name")
    out = cases.select("case_id").distinct().join(t.dropDuplicates(["case_id"]), "case_id", "left")

    def missing(c: str) -> Column:
        if strict:
            return F.raise_error(F.concat(F.lit(f"no sequence {seq_name} in case "), F.col("case_id").cast("string"))).cast("double")
        return F.lit(1.0 if c in ("r11", "r22", "r33") else 0.0)

    return out.select("case_id", *[F.coalesce(c, missing(c)).alias(c) for c in RTM])


CONTOUR = (
    "_ImageName string, QVAS_Contour array<struct<ContourType:string,Contour_Point:struct<Point:array<struct<_x:double,_y:double>>>,"
    "ContourConf:struct<LumenConsistency:double,WallConsistency:double>>>"
)


def scan_contours(spark: SparkSession, path: str, size: float, scale: float = 1.0, rounded: bool = False) -> DataFrame:
    """Contour points (case_id, slice_no, kind, seq, px, py); equal neighbours are dropped."""
    img = scan_xml(spark, path, "QVAS_Image", CONTOUR)
    c = img.select("case_id", F.regexp_extract("_ImageName", r"I(\d+)$", 1).cast("int").alias("slice_no"), F.explode("QVAS_Contour").alias("c"))
    pts = c.select("case_id", "slice_no", F.col("c.ContourType").alias("kind"), F.posexplode("c.Contour_Point.Point").alias("seq", "p"))
    x, y = (F.col(f"p._{a}") / 512 * size * scale for a in "xy")
    if rounded:
        x, y = F.bround(x), F.bround(y)
    return drop_repeats(pts.select("case_id", "slice_no", "kind", F.col("seq").cast("bigint").alias("seq"), x.alias("px"), y.alias("py")))


def drop_repeats(contours: DataFrame) -> DataFrame:
    keys = ["case_id", "slice_no", "kind"]
    near = neighbours(contours, keys, "seq", {"_px": ("px", -1), "_py": ("py", -1)})
    return near.where("_px is null or px <> _px or py <> _py").drop("_px", "_py")


def scan_slice_quality(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, idx, iq) with ``place`` counted from 0 in index order."""
    return scan_xml(spark, path, "Location", "_Index int, IQ int").select("case_id", F.col("_Index").alias("idx"), F.col("IQ").alias("iq"))


def quality_at(quality: DataFrame, bifurcation: DataFrame, slices: DataFrame) -> DataFrame:
    """Quality of image slices (case_id, slice_no) through the bifurcation offset; 0 outside.

    Locations are listed in index order without gaps from the first index on.
    """
    first = quality.groupBy("case_id").agg(F.min("idx").alias("_first"))
    shift = bifurcation.join(first, "case_id").select("case_id", "_first", (F.col("bif") - (-1 - F.col("_first"))).alias("_off"))
    at = slices.join(shift, "case_id").withColumn("idx", F.col("slice_no") - F.col("_off") + F.col("_first"))
    return at.join(quality, ["case_id", "idx"], "left").select("case_id", "slice_no", F.coalesce("iq", F.lit(0)).alias("iq"))


def contour_to_image(contours: DataFrame, size: float, cx: float = 64, cy: float = 64, scale: float = 4, half: float = 256) -> DataFrame:
    """Patch coordinates to the 512 grid of the contour file."""
    return contours.withColumns({
        "px": F.round((F.col("px") / scale + cx - half / scale) / size * 512, 5), "py": F.round((F.col("py") / scale + cy - half / scale) / size * 512, 5),
    })


def control_points(contours: DataFrame) -> DataFrame:
    """Six points of every contour at ``n // 6 * i``."""
    keys = ["case_id", "slice_no", "kind"]
    n = contours.groupBy(*keys).agg(F.floor(F.count("*") / 6).alias("_s"))
    six = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("seq", F.col("_s") * F.col("i"))
    return six.join(contours, [*keys, "seq"]).drop("_s")


def write_xml(rows: DataFrame, path: str, row: str, root: str) -> None:
    rows.write.format("xml").options(rowTag=row, rootTag=root).save(path)


def contour_area(contours: DataFrame) -> DataFrame:
    """Shoelace area of every closed contour."""
    keys = ["case_id", "slice_no", "kind"]
    near = neighbours(contours, keys, "seq", {"_nx": ("px", 1), "_ny": ("py", 1)})
    part = F.col("px") * F.col("_ny") - F.col("_nx") * F.col("py")
    a = near.groupBy(*keys).agg(
        F.coalesce(F.sum(part), F.lit(0.0)).alias("s"), *[F.min_by(c, "seq").alias(f"f{c}") for c in ("px", "py")], *[F.max_by(c, "seq").alias(f"l{c}") for c in ("px", "py")]
    )
    return a.select(*keys, (F.abs(F.col("s") + F.col("lpx") * F.col("fpy") - F.col("fpx") * F.col("lpy")) / 2).alias("area"))


def wall_measures(contours: DataFrame, inner: str = "Lumen", outer: str = "Outer Wall") -> DataFrame:
    """Areas and wall thickness (distance of outer points to the nearest inner point) per slice."""
    from ..plans.grid import nearest_growing

    keys = ["case_id", "slice_no"]
    z = F.lit(0.0)
    t = contours.where(F.col("kind") == inner).select(*keys, F.col("px").alias("x"), F.col("py").alias("y"), z.alias("z"))
    q = contours.where(F.col("kind") == outer).select(*keys, F.col("seq").alias("q_seq"), F.col("px").alias("qx"), F.col("py").alias("qy"), z.alias("qz"))
    d = nearest_growing(q, t, 2.0, ["qx", "qy", "qz"], [*keys, "q_seq"], ["x", "y"], keys=keys)
    thick = d.groupBy(*keys).agg(F.max("dist").alias("max_thick"), F.min("dist").alias("min_thick"), F.avg("dist").alias("avg_thick"), F.stddev_pop("dist").alias("std_thick"))
    area = contour_area(contours)
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("area")))
    areas = area.groupBy(*keys).agg(pick(inner).alias("lumen_area"), (pick(outer) - pick(inner)).alias("wall_area"))
    return areas.join(thick, keys, "left")


def contour_consistency(predictions: DataFrame) -> DataFrame:
    """1 - mean deviation of rotated predictions times sqrt(12): (case_id, slice_no, kind, i, rotation, rho)."""
    std = predictions.groupBy("case_id", "slice_no", "kind", "i").agg(F.stddev_pop("rho").alias("s"), F.avg("rho").alias("m"))
    return std.groupBy("case_id", "slice_no", "kind").agg((1 - F.avg(F.col("s") * F.lit(12.0) ** 0.5)).alias("consistency"), F.avg("m").alias("mean_rho"))

