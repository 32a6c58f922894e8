"""Incremental ingest of archive files with Structured Streaming.

New monthly JSON files dropped under the archive folder are picked up by the
file source (``maxFilesPerTrigger`` bounds a micro-batch); every micro-batch
runs the same article and phrase operators as the batch ingest and writes its
rows as ``year=/month=/ingest_batch=<id>`` partitions with dynamic overwrite.
A retried micro-batch therefore replaces exactly its own output — together
with the checkpointed file-source offsets this gives exactly-once files
without any external state store.  The checkpoint location must be on shared
storage (it defaults to a folder under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.operators.ingest import ARTICLE_COLUMNS, phrases_of_articles
from tempora.session import ensure_checkpoint_dir, shared_table
from tempora.sources.archive import RAW_SCHEMA, articles_from_archive


def archive_stream(spark: SparkSession, raw_dir: str, max_files_per_trigger: int = 16) -> DataFrame:
    raw = (spark.readStream.schema(RAW_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(raw_dir))
    return raw.select(F.explode("response.docs").alias("doc"), F.col("_metadata.file_path").alias("file_path"))


def _write_batch(frame: DataFrame, path: str, batch_id: int) -> None:
    (frame.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
     .withColumn("ingest_batch", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month", "ingest_batch").parquet(path))


def start_ingest_stream(spark: SparkSession, raw_dir: str, root: str, checkpoint: str | None = None,
                        max_phrases: int | None = None, context_radius: int = 40, once: bool = False,
                        max_files_per_trigger: int = 16) -> StreamingQuery:
    base = root.rstrip("/")
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/archive-ingest-stream"

    def process(batch: DataFrame, batch_id: int) -> None:
        # Parsed once per micro-batch; the tables have a root of their own, apart from those of the batch ingest.
        articles = shared_table(articles_from_archive(batch), f"batch-{batch_id}")
        _write_batch(articles.select(*ARTICLE_COLUMNS), f"{base}/stream_articles", batch_id)
        _write_batch(phrases_of_articles(articles, max_phrases, context_radius), f"{base}/stream_phrases", batch_id)

    writer = (archive_stream(spark, raw_dir, max_files_per_trigger).writeStream.foreachBatch(process)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()
