"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows in memory against the same rows in a file.  Voxels, nodes and links of a stored table take one to four bytes each
#: in Parquet, as their columns repeat, and 40 to 100 in a row of a hash table.
FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"
ROWS_BY_FILE = 32.0


def sized_by_rows(spark: SparkSession) -> None:
    """Plan joins by the size that files have as rows, so that the driver never builds a large table from a small file.

    Small sides are still broadcast: adaptive execution takes the true size once a side is shuffled.
    A greater factor that a cluster has set stays.
    """
    if float(spark.conf.get(FILE_FACTOR, "1.0")) < ROWS_BY_FILE:
        spark.conf.set(FILE_FACTOR, str(ROWS_BY_FILE))


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vesselspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when there is a single machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="vesselspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimizer true sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``stored`` made, once nothing reads it any more; loops use it for their old rounds."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if not folder.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).toUri().getPath()):
            raise ValueError("only tables in the shared folder are deleted")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
