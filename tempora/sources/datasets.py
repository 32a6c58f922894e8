"""Parquet datasets: scan, partitioned sink, whole-dataset sink, presence.

Layout: ``<root>/<dataset>/`` — the two base tables (``articles``,
``phrases``) are Hive-partitioned ``year=YYYY/month=MM``; derived tables are
plain folders.  Compression is zstd.  Replacing a partition or a dataset is
Spark's own commit protocol (``mode('overwrite')`` with dynamic partition
overwrite), so a failed job never leaves half a partition behind and a re-run
after a lost executor simply recomputes the lost tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTITION_COLUMNS = ("year", "month")


def dataset_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/{dataset}"


def dataset_exists(spark: SparkSession, root: str, dataset: str) -> bool:
    """True when any Parquet file exists below the dataset folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(dataset_path(root, dataset))
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return False
    files = fs.listFiles(path, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if name.endswith(".parquet") and not name.startswith((".", "_")):
            return True
    return False


def read_dataset(spark: SparkSession, root: str, dataset: str, columns: list[str] | None = None,
                 schema: StructType | None = None, required: bool = False) -> DataFrame | None:
    """Scan a dataset (column pruning and partition pruning are Spark's).

    Returns ``None`` for an absent optional dataset, an empty frame when a
    schema is given, and raises for an absent required one.
    """
    if not dataset_exists(spark, root, dataset):
        if required:
            raise FileNotFoundError(f"No Parquet files found for dataset: {dataset_path(root, dataset)}")
        if schema is not None:
            empty = spark.createDataFrame([], schema)
            return empty.select(*columns) if columns else empty
        return None
    frame = spark.read.parquet(dataset_path(root, dataset))
    return frame.select(*columns) if columns else frame


def write_partitioned(frame: DataFrame, root: str, dataset: str, sort_by: str | None = None) -> None:
    """Replace the ``year=/month=`` partitions present in ``frame``.

    Other partitions are left alone (dynamic partition overwrite).  Month
    folders are written zero-padded (``month=01``).  Rows are clustered by
    partition with a *rebalance* (not a plain repartition): AQE keeps each
    month in as few tasks as possible, splits a month that is too large for
    one task (a hot month cannot pin one writer) and merges small ones.
    """
    staged = frame.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    staged = staged.hint("rebalance", *PARTITION_COLUMNS)
    if sort_by:
        staged = staged.sortWithinPartitions(*PARTITION_COLUMNS, sort_by)
    (staged.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd")
     .partitionBy(*PARTITION_COLUMNS)
     .parquet(dataset_path(root, dataset)))


def replace_dataset(frame: DataFrame, root: str, dataset: str, sort_by: str | None = None) -> None:
    """Replace a whole derived dataset; ``sort_by`` clusters rows inside each
    file so point lookups can skip row groups by min/max."""
    staged = frame.sortWithinPartitions(sort_by) if sort_by else frame
    staged.write.mode("overwrite").option("compression", "zstd").parquet(dataset_path(root, dataset))
