"""Files in phrase order: JSON lines of the training set, and point lookups on a sorted dataset."""

import glob
import json

from pyspark.sql import functions as F

from tempora.sources.datasets import read_dataset, replace_dataset
from tempora.sources.jsonl import read_training_jsonl, write_training_jsonl


def training(spark, rows):
    return spark.range(rows).select(
        F.sha2(F.col("id").cast("string"), 256).alias("phrase"), F.col("id").cast("string").alias("phrase_hash"),
        F.struct(F.lit(1901).alias("first_year"), F.lit(1999).alias("last_year"), F.lit(1950).alias("peak_year"),
                 F.lit("1950s").alias("peak_decade"), F.col("id").alias("total_count"),
                 (F.col("id") / 7).alias("temporal_entropy")).alias("features"),
        F.create_map(F.lit("1900s"), F.col("id") / rows, F.lit("1950s"), 1 - F.col("id") / rows).alias("target"))


def test_exported_files_follow_each_other_and_read_back_equal(spark, scratch):
    rows = training(spark, 3000)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        write_training_jsonl(rows, f"{scratch}/t")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = [[json.loads(line)["phrase"] for line in open(f)] for f in sorted(glob.glob(f"{scratch}/t/part-*"))]
    files = [f for f in files if f]
    assert len(files) > 1 and sum(files, []) == sorted(r["phrase"] for r in rows.collect())
    back = read_training_jsonl(spark, f"{scratch}/t")
    flat = [F.col("phrase"), F.col("phrase_hash"), F.col("features"), F.sort_array(F.map_entries("target")).alias("t")]
    assert back.count() == 3000 and back.select(*flat).exceptAll(rows.select(*flat)).isEmpty()


def test_point_lookup_skips_row_groups(spark, scratch):
    rows = 200_000
    table = spark.range(rows).select(F.sha2(F.col("id").cast("string"), 256).alias("phrase_hash"), F.col("id").alias("raw_count"))
    # Small row groups, so that one file has many.
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(256 << 10))
    try:
        replace_dataset(table, scratch, "timelines", sort_by="phrase_hash")
    finally:
        hadoop.unset("parquet.block.size")
    asked = table.where("raw_count = 4711").first()["phrase_hash"]
    found = read_dataset(spark, scratch, "timelines").where(F.col("phrase_hash") == asked)
    assert [r["raw_count"] for r in found.collect()] == [4711]
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 0 < read < rows / 4


def test_asked_phrases_are_cleaned_once_and_stay_where_the_join_puts_them(spark):
    from tempora.operators import inspect, timelines

    rows = spark.createDataFrame([("steam engine", "1900s", 0.5), ("steam engine", "1910s", 0.5), ("mill", "1900s", 1.0), (None, "1900s", 1.0)],
                                 "phrase string, decade string, target_probability double")
    found = timelines.with_phrase_hash(rows.withColumn("decade_raw_count", F.lit(1)).withColumn("decade_score", F.col("target_probability")))
    asked = found.select(F.upper("phrase").alias("phrase")).unionByName(spark.createDataFrame([("Mill!!",), ("other",)], "phrase string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        targets = inspect.inspect_targets(asked, found, top=1)
        plan = targets._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["asked"] or "", r["cleaned_phrase"], r["decade"], r["target_rank"], r["is_top"]) for r in targets.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("", None, "1900s", 1, True), ("MILL", "mill", "1900s", 1, True), ("Mill!!", "mill", "1900s", 1, True),
                   ("STEAM ENGINE", "steam engine", "1900s", 1, True), ("STEAM ENGINE", "steam engine", "1910s", 2, False)]
    # Below the distinct nothing is cleaned for a filter; the window needs no exchange of its own.
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 3
