"""Validation of phrase input sets (``id, phrase, expected_decade``).

Errors (one row each, ``error, subject``):
* ``missing id`` / ``missing phrase`` — empty or absent value (subject: the
  row's phrase or id, since a distributed scan has no line numbers);
* ``missing expected_decade`` — only when required;
* ``invalid expected_decade`` — a value outside the 18 decades 1850s..2020s;
* ``duplicate id`` — an id used more than once;
* ``decade below minimum`` — when ``min_per_decade > 0``: every decade present
  among the valid expected decades (or all 18 when none is present) with
  fewer rows than the minimum.

Also: counts by expected decade and by input size group, and a one-row
summary (rows, errors, valid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.sizes import input_size

# Fixed value: the decade domain accepted in input sets (1850s .. 2020s).
FIRST_DECADE, LAST_DECADE = 1850, 2020


def valid_decades(spark: SparkSession) -> DataFrame:
    return spark.range(FIRST_DECADE, LAST_DECADE + 1, 10).select(
        F.concat(F.col("id").cast("string"), F.lit("s")).alias("decade"))


def _present(col):
    return col.isNotNull() & (col.cast("string") != "")


def validation_errors(inputs: DataFrame, require_expected: bool = False, min_per_decade: int = 0) -> DataFrame:
    spark = inputs.sparkSession
    id_, phrase = F.col("id").cast("string"), F.col("phrase").cast("string")
    expected = F.col("expected_decade").cast("string") if "expected_decade" in inputs.columns \
        else F.lit(None).cast("string")
    decades = [f"{y}s" for y in range(FIRST_DECADE, LAST_DECADE + 1, 10)]
    rows = inputs.select(id_.alias("id"), phrase.alias("phrase"), expected.alias("expected"))
    kinds = [
        F.when(~_present(F.col("id")), F.struct(F.lit("missing id").alias("error"),
                                               F.coalesce(F.col("phrase"), F.lit("")).alias("subject"))),
        F.when(~_present(F.col("phrase")), F.struct(F.lit("missing phrase").alias("error"),
                                                   F.coalesce(F.col("id"), F.lit("")).alias("subject"))),
        F.when(_present(F.col("expected")) & ~F.col("expected").isin(*decades),
               F.struct(F.lit("invalid expected_decade").alias("error"),
                        F.concat_ws(" ", F.coalesce(F.col("id"), F.lit("")),
                                    F.concat(F.lit("expected_decade="), F.col("expected"))).alias("subject"))),
    ]
    if require_expected:
        kinds.append(F.when(~_present(F.col("expected")),
                            F.struct(F.lit("missing expected_decade").alias("error"),
                                     F.coalesce(F.col("id"), F.lit("")).alias("subject"))))
    row_errors = rows.select(F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("e")).select("e.*")
    duplicates = (rows.where(_present(F.col("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 1).select(F.lit("duplicate id").alias("error"), F.col("id").alias("subject")))
    errors = row_errors.unionByName(duplicates)
    if min_per_decade > 0:
        counts = decade_counts(inputs)
        # Decades without a row are checked only when no valid decade is present.
        every = valid_decades(spark).join(counts, "decade", "left").fillna(0, ["rows"])
        present = F.max("rows").over(Window.partitionBy(F.lit(0)))
        checked = every.withColumn("present", present).where((F.col("rows") > 0) | (F.col("present") == 0)).drop("present")
        low = checked.where(F.col("rows") < min_per_decade).select(
            F.lit("decade below minimum").alias("error"),
            F.format_string("decade %s has %d examples; expected at least %d", F.col("decade"), F.col("rows"),
                            F.lit(min_per_decade)).alias("subject"))
        errors = errors.unionByName(low)
    return errors


def decade_counts(inputs: DataFrame) -> DataFrame:
    decades = [f"{y}s" for y in range(FIRST_DECADE, LAST_DECADE + 1, 10)]
    expected = F.col("expected_decade").cast("string")
    return (inputs.where(expected.isin(*decades)).groupBy(expected.alias("decade"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("rows")))


def size_counts(inputs: DataFrame) -> DataFrame:
    phrase = F.col("phrase").cast("string")
    return (inputs.where(_present(phrase)).groupBy(input_size(phrase)["group"].alias("input_size_group"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("rows")))


def validation_summary(inputs: DataFrame, require_expected: bool = False, min_per_decade: int = 0) -> DataFrame:
    """One row: input rows, error rows and whether the set is valid."""
    errors = validation_errors(inputs, require_expected, min_per_decade)
    marked = (inputs.select(F.lit(1).alias("is_row"), F.lit(0).alias("is_error"))
              .unionByName(errors.select(F.lit(0).alias("is_row"), F.lit(1).alias("is_error"))))
    totals = marked.agg(F.coalesce(F.sum("is_row"), F.lit(0)).cast("bigint").alias("rows"),
                        F.coalesce(F.sum("is_error"), F.lit(0)).cast("bigint").alias("errors"))
    return totals.select("rows", "errors", (F.col("errors") == 0).alias("valid"))
