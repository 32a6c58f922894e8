"""Helpers shared by the operators: hand-over tables in the shared folder, global row numbers and 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only for a single-process session without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tempora-llm-")
        context.setCheckpointDir(folder)
    return folder


def handed_over(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as a Parquet table in the shared folder and read it back: later steps do not repeat the
    work before it, and a lost executor costs no more than its own tasks."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.handed_over_at = path
    return table


def removed(*tables: DataFrame) -> None:
    """Remove hand-over tables whose last reader has written its own result; other frames stay as they are."""
    for table in tables:
        if path := getattr(table, "handed_over_at", None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of each execution when it ends, not when the driver's garbage collector finds them: steps
    that write their results need them no more.  A later execution of the same frame would compute them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


BATCH_BYTES = 8 << 20


def in_small_batches(frame: DataFrame) -> DataFrame:
    """``frame``, in a session whose Arrow batches hold at most ``BATCH_BYTES``: rows of texts are a few kilobytes each, and the default of
    64 MB is held several times over (in the JVM's buffers, in Arrow and as Python objects) by each task.  No result depends on it."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, "64m").rstrip("bkmg")) != BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return frame


def numbered(frame: DataFrame, name: str, *order) -> DataFrame:
    """``frame`` with ``number`` (long, from 0), its rows' place under ``order`` (columns or their names).

    Rows are dealt by ranges and sorted within them; a row's place is its place in its range plus the rows of the ranges
    before, so no task has more than a range.  Rows that are equal under ``order`` lie in one range: add a tie-breaker.
    """
    ranged = handed_over(frame, f"{name}-rows").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = handed_over(ranged.withColumn("_at", F.monotonically_increasing_id()), f"{name}-ranges")
    part = F.shiftright("_at", 33)
    # One row a range: as many as the shuffle has partitions.
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_before")))
    return (placed.withColumn("_part", part).join(starts, "_part")
            .withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at"))


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    out = values ^ (values >> np.uint64(30))
    out *= _A
    out ^= out >> np.uint64(27)
    out *= _B
    out ^= out >> np.uint64(31)
    return out
