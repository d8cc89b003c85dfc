"""Running metrics over a stream of per-case metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder


def running_epoch_metrics(rows: DataFrame, late: str | None = None) -> DataFrame:
    """Totals per (epoch, name) so far: ``seg_*`` summed, others averaged by sample count.

    A case counts once per epoch and name.  By default the state remembers every (epoch, case, name), so a row
    that comes however late still corrects its epoch's total, in files of any order.  With ``late`` the state is
    bounded: rows further behind the newest ``ts`` are dropped.
    """
    key = ["epoch", "case_id", "name"]
    once = rows.dropDuplicates(key) if late is None else rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    total, mean = F.sum("value"), F.sum(F.col("value") * F.col("n")) / F.sum("n")
    return once.groupBy("epoch", "name").agg(F.when(F.col("name").startswith("seg_"), total).otherwise(mean).alias("value"))


def best_so_far(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Best metric value per run (name) and the case that reached it; equal values: lower case."""
    key = F.struct("value", (-F.col("case_id")).alias("c"))
    best = rows.withWatermark("ts", late).groupBy("name").agg(F.max(key).alias("m"))
    return best.select("name", F.col("m.value").alias("best"), (-F.col("m.c")).alias("case_id"))


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drain the stream in update mode and return the latest row per key.

    Updates are appended to a table in the shared folder with their batch number, so a
    restarted query repeats a batch without changing the result.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b{number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    got = spark.read.parquet(f"{base}/out/*")
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_m")).select(*keys, "_m.*")


def metric_stream(spark, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Per-case metric rows from a folder of event files."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    kind = F.col("event_type")
    return ev.select(
        F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").cast("string").alias("epoch"), F.col("event_id").alias("case_id"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("seg_"), kind)).otherwise(kind).alias("name"), "value", (1 + F.col("event_id") % 3).alias("n"),
    )
