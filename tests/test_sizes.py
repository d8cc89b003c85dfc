"""Joins of tables that are small as files and large as rows."""

from pyspark.sql import functions as F

from vesselspark import catalog
from vesselspark.session import stored

catalog.load()


def joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    catalog.QUERIES["max_box"](spark, "/root/testdata/sf0.001")
    place = F.xxhash64("id")
    grid = spark.range(1_500_000).select(
        F.floor(F.col("id") / 2560).alias("case_id"), *[F.shiftright(place, k).bitwiseAND(F.lit(15).cast("long")).alias(c) for c, k in zip("xyz", (0, 4, 8))]
    )
    voxels = stored(grid, "grid")
    plan = joins(voxels.join(voxels.withColumnRenamed("z", "w"), ["case_id", "x", "y"]))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
