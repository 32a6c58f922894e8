"""Spark session helpers.

Library code never builds its own session: every operator takes DataFrames
and returns DataFrames.  These helpers exist for tests, the bench and the
command-line jobs, and for the one piece of cluster plumbing we need — the
shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on; a cluster deployment sets the same keys in its
# own defaults.  AQE stays on so shuffle partition counts and skewed joins are
# re-planned at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tempora",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("TEMPORA_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="tempora-ckpt-")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The deployment sets it (``local_session`` does for tests and the bench);
    library code never chooses a folder, except a scratch one for a
    single-process session (``local`` or ``local[n]``) that names none.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="tempora-shared-")
        sc.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/tempora-{uuid.uuid4().hex}/{name}"


def shared_table(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as a Parquet table in the shared folder and read back, so that later steps
    neither repeat its work nor depend on an executor's disk."""
    path = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
