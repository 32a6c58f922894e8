"""JSON-lines inputs and outputs.

* ``read_inputs``: phrase input sets (``id, phrase`` and optional ``group``,
  ``expected_decade``, ``note``, ``source_note``, ``review_status``).  Blank
  lines are skipped; a line that is not a JSON object or lacks a non-empty
  ``id`` or ``phrase`` fails the job with an error naming the file and the
  line text (a distributed scan has no line numbers).  The check is part of
  the plan (``raise_error``), so it costs no extra pass.
* ``read_training_jsonl`` / ``write_training_jsonl``: training rows
  (``phrase, phrase_hash, features struct, target map``), written one object
  per line in phrase order.
* ``write_predictions_jsonl``: prediction rows with the distribution as a map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INPUT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("phrase", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("expected_decade", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("source_note", T.StringType()),
    T.StructField("review_status", T.StringType()),
])

FEATURES_SCHEMA = T.StructType([
    T.StructField("first_year", T.IntegerType()),
    T.StructField("last_year", T.IntegerType()),
    T.StructField("peak_year", T.IntegerType()),
    T.StructField("peak_decade", T.StringType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("temporal_entropy", T.DoubleType()),
])
TRAINING_SCHEMA = T.StructType([
    T.StructField("phrase", T.StringType()),
    T.StructField("phrase_hash", T.StringType()),
    T.StructField("features", FEATURES_SCHEMA),
    T.StructField("target", T.MapType(T.StringType(), T.DoubleType())),
])


def read_inputs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_inputs(spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file")), strict)


def parse_inputs(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Input rows from lines of text (``value``, ``_file``); blank lines are skipped, a bad line is an error when strict."""
    lines = lines.where(F.col("value").rlike(r"\S"))
    parsed = lines.select("value", "_file", F.from_json("value", INPUT_SCHEMA).alias("row"))
    if not strict:
        return parsed.select("row.*")
    bad = (F.col("row").isNull() | F.coalesce(F.col("row.id"), F.lit("")).eqNullSafe("")
           | F.coalesce(F.col("row.phrase"), F.lit("")).eqNullSafe(""))
    checked = parsed.select(
        F.when(bad, F.raise_error(F.concat(F.lit("Invalid input row in "), F.col("_file"), F.lit(": "),
                                           F.col("value")))).alias("_check"), "row")
    # The check column must be computed for every row, so it is kept in the
    # projection and folded into a filter that is always true.
    return checked.where(F.col("_check").isNull()).select("row.*")


def read_training_jsonl(spark: SparkSession, path: str, max_rows: int | None = None,
                        require_rows: bool = True) -> DataFrame:
    """Training rows; ``max_rows`` keeps the first rows in phrase order."""
    rows = spark.read.schema(TRAINING_SCHEMA).json(path)
    if max_rows is not None:
        rows = rows.orderBy("phrase", "phrase_hash").limit(max_rows)
    if require_rows and rows.isEmpty():
        raise ValueError(f"Training dataset has no rows: {path}")
    return rows


def write_training_jsonl(training: DataFrame, path: str) -> None:
    """One JSON object per phrase, in phrase order (a range-partitioned sort,
    so every output file holds a contiguous phrase range)."""
    (training.select("phrase", "phrase_hash", "features", "target")
     .orderBy("phrase").write.mode("overwrite").json(path))


def write_predictions_jsonl(predictions: DataFrame, path: str) -> None:
    out = predictions
    if "decades" in out.columns and isinstance(out.schema["decades"].dataType, T.ArrayType):
        out = out.withColumn("decades", F.map_from_entries("decades"))
    out.write.mode("overwrite").json(path)
