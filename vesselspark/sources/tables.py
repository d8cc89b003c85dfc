"""Cohort tables: metadata CSV, sample lists, manifests, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.blocks import ranked
from ..session import stored


def int_array(c: Column) -> Column:
    """``[1, 2]``, ``(1, 2)``, ``[1 2]`` or ``-1`` to an array of ints; a lone -1 is NULL."""
    parts = F.split(F.trim(F.regexp_replace(c, r"[\[\]\(\)]", "")), r"[,\s]+")
    return F.when(~parts.getItem(0).eqNullSafe(F.lit("-1")) | (F.size(parts) > 1), parts.cast("array<int>"))


def double_array(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"[\[\]\(\)]", "")), r"[,\s]+").cast("array<double>")


def parse_meta(meta: DataFrame) -> DataFrame:
    return meta.withColumns({"pos_s": int_array(F.col("pos_s")), "spacing": double_array(F.col("spacing"))})


def scan_meta(spark: SparkSession, path: str) -> DataFrame:
    return parse_meta(spark.read.csv(path, header=True))


def parse_extra(extra: Column) -> tuple[Column, Column]:
    """``[x0 x1 y0 y1 z0 z1],[s0 s1 s2]`` to box (NULL for [-1]) and spacing."""
    return int_array(F.regexp_extract(extra, r"^(\[[^\]]*\])", 1)), double_array(F.regexp_extract(extra, r",(\[[^\]]*\])$", 1))


def format_extra(pos: Column, spacing: Column) -> Column:
    box = F.coalesce(F.array_join(pos.cast("array<string>"), " "), F.lit("-1"))
    return F.concat(F.lit("["), box, F.lit("],["), F.array_join(spacing.cast("array<string>"), " "), F.lit("]"))


def datalist_entries(doc: DataFrame) -> DataFrame:
    """Entries of a sample list (test, training, validation arrays) with their ``split``."""
    kinds = dict(doc.dtypes)  # the type of a list that is always empty is not known
    some = [s for s in ("training", "validation", "test") if kinds.get(s, "").startswith("array<struct")]
    parts = [doc.select(F.lit(s).alias("split"), F.explode(s).alias("e")).select("split", "e.*") for s in some]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def scan_datalist(spark: SparkSession, path: str) -> DataFrame:
    return datalist_entries(spark.read.json(path, multiLine=True))


SPLITS = ("test", "training", "validation")


def manifest(entries: DataFrame, name: str, labels: dict[int, str]) -> DataFrame:
    """A sample list as the ordered lines of one JSON document: (section, place, split, value).

    Section 0 is the header with name, label map and counts; then each split has an opening line, its
    entries by id and a closing line.  Entries are range-partitioned and ranked, so no task holds the list.
    ``id`` is not written.
    """
    cols = [c for c in entries.columns if c not in ("split", "id")]
    listed = entries.where(F.col("split").isin(*SPLITS))
    row = ranked(listed.select("split", "id", F.to_json(F.struct(*cols)).alias("value")), [F.col("split"), F.col("id"), F.col("value")], "_rank")
    row = stored(row, "entries")
    size = row.groupBy("split").agg(F.count("*").alias("_n"), F.max("_rank").alias("_last"))
    number = F.create_map(*[F.lit(v) for i, s in enumerate(SPLITS) for v in (s, i + 1)])
    body = row.join(F.broadcast(size), "split").select(  # one row for each split
        number[F.col("split")].alias("section"), (F.col("_rank") - F.col("_last") + F.col("_n")).alias("place"), "split",
        F.concat("value", F.when(F.col("_rank") < F.col("_last"), ",").otherwise("")).alias("value"),
    )
    label_map = F.create_map(*[F.lit(str(v)) for kv in labels.items() for v in kv])
    count = size.agg(*[F.coalesce(F.max(F.when(F.col("split") == s, F.col("_n"))), F.lit(0)).alias(f"num{s.capitalize()}") for s in SPLITS])
    header = count.select(F.to_json(F.struct(F.lit(name).alias("name"), label_map.alias("labels"), *count.columns)).alias("_h"))
    header = header.select(F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("string").alias("split"), F.expr("concat(left(_h, length(_h) - 1), ',')").alias("value"))
    frame = [(i + 1, p, s, v) for i, s in enumerate(SPLITS) for p, v in ((0, f'"{s}": ['), (1 << 62, "]}" if s == SPLITS[-1] else "],"))]
    frame = entries.sparkSession.createDataFrame(frame, "section int, place bigint, split string, value string")
    return header.unionByName(frame).unionByName(body)


def write_manifest(lines: DataFrame, path: str) -> None:
    """The document as one text file in the folder ``path``; a single task writes it, line by line."""
    lines.orderBy("section", "place").select("value").coalesce(1).write.mode("overwrite").text(path)


def parse_box_text(files: DataFrame) -> DataFrame:
    """Whole files (case_id, value): size line and location line to a box, truncating."""
    lines = F.split("value", "\n")
    nums = lambda i: F.split(F.trim(F.regexp_extract(lines[i], r"([^:]*)$", 1)), r"\s+").cast("array<double>")
    f = files.withColumns({"_s": nums(1), "_l": nums(2)})
    lo = [F.col("_l")[i].cast("int").alias(f"{c}0") for i, c in enumerate("xyz")]
    hi = [(F.col("_l")[i] + F.col("_s")[i]).cast("int").alias(f"{c}1") for i, c in enumerate("xyz")]
    return f.select("case_id", *lo, *hi)


def parse_slice_boxes(lines: DataFrame, classes: int) -> DataFrame:
    """``xmin ymin xmax ymax conf class`` lines (slice_no, value) to centre, size and class scores."""
    f = F.split(F.trim("value"), r"\s+").cast("array<double>")
    b = lines.where(F.size(F.split(F.trim("value"), r"\s+")) == 6).withColumn("_f", f)
    v = [F.col("_f")[i] for i in range(6)]
    return b.select(
        *[c for c in lines.columns if c != "value"], ((v[0] + v[2]) / 2).alias("bx"), ((v[1] + v[3]) / 2).alias("by"), (v[2] - v[0]).alias("bw"), (v[3] - v[1]).alias("bh"), v[4].alias("conf"),
        F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == v[5].cast("int"), v[4]).otherwise(F.lit(0.0))).alias("scores"),
    )


def scan_slice_boxes(spark: SparkSession, path: str, classes: int) -> DataFrame:
    no = F.regexp_extract(F.col("_metadata.file_path"), r"_(\d+)\.[^./]+$", 1).cast("int")
    return parse_slice_boxes(spark.read.text(path).select(no.alias("slice_no"), "value"), classes)


def scan_curves(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Curve CSVs of several experiments (folder name = experiment), with model names."""
    exp = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    raw = spark.read.csv(path, header=True, inferSchema=True)
    return raw.withColumn("experiment", exp).join(names, "experiment", "left")


def inventory(paths: DataFrame, sources: list[str]) -> DataFrame:
    """Which image sources exist per case: file names ``TH_<case><source>.<ext>`` to flags."""
    base = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    src = F.regexp_extract(base, "_(" + "|".join(sources) + ")$", 1)
    p = paths.select(F.regexp_replace(base, "_(" + "|".join(sources) + ")$", "").alias("case_id"), src.alias("src")).where("src <> ''")
    return p.groupBy("case_id").agg(*[F.bool_or(F.col("src") == s).alias(s) for s in sources])


def check_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Image and label presence per case: ok, no label, no image."""
    a = images.select("case_id").distinct().withColumn("_i", F.lit(True))
    b = labels.select("case_id").distinct().withColumn("_l", F.lit(True))
    return a.join(b, "case_id", "full").select(
        "case_id", F.when(F.col("_i").isNull(), "no image").when(F.col("_l").isNull(), "no label").otherwise("ok").alias("state")
    )


def require_pairs(pairs: DataFrame) -> DataFrame:
    """Raise when a task meets an incomplete pair."""
    bad = F.raise_error(F.concat(F.lit("incomplete case "), F.col("case_id").cast("string")))
    return pairs.withColumn("state", F.when(F.col("state") == "ok", F.col("state")).otherwise(bad.cast("string")))


def copy_plan(source: DataFrame, target: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Files (case_id, name) of the source that the target lacks, for the wanted cases."""
    s = source if wanted is None else source.join(wanted, "case_id", "left_semi")
    return s.join(target, ["case_id", "name"], "left_anti")


def scan_volume_npy(spark: SparkSession, path: str, sparse: bool = True) -> DataFrame:
    """``.npy`` volumes to voxel rows (case_id, x, y, z, v); zeros are skipped if ``sparse``."""
    import io

    import numpy as np
    import pandas as pd

    def decode(batches):
        for pdf in batches:
            for case, content in zip(pdf["case_id"], pdf["content"]):
                vol = np.load(io.BytesIO(content))
                for x in range(vol.shape[0]):  # plane by plane, so rows never hold a whole volume
                    plane = vol[x]
                    y, z = np.nonzero(plane) if sparse else np.indices(plane.shape).reshape(2, -1)
                    yield pd.DataFrame({"case_id": case, "x": np.int64(x), "y": y.astype("int64"), "z": z.astype("int64"), "v": plane[y, z].astype("float64")})

    from .swc import case_of

    files = spark.read.format("binaryFile").load(path).select(case_of(F.col("path")).alias("case_id"), "content")
    return files.mapInPandas(decode, "case_id string, x long, y long, z long, v double")


def vessel_id_image(voxels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Painted ids to vessel types by a small table (painted_id, vestype)."""
    return voxels.join(mapping.withColumnRenamed("painted_id", "v"), "v", "left").withColumn("vestype", F.coalesce("vestype", F.lit(0)))


def parse_case_metrics(lines: DataFrame) -> DataFrame:
    """Alternating lines (n, value): case id, then a dict literal; one row per metric."""
    ids = lines.where("n % 2 = 0").select((F.col("n") + 1).alias("n"), F.col("value").alias("case_id"))
    body = F.from_json(F.regexp_replace("value", "'", '"'), "map<string,double>")
    return lines.where("n % 2 = 1").join(ids, "n").select("case_id", F.explode(body).alias("name", "metric"))


def write_curve(curve: DataFrame, path: str) -> None:
    curve.write.csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the rows of ``old`` that share a key with ``new``, then add ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
