"""Deterministic ids equal SHA-256 of the sorted-key JSON text."""

import hashlib
import json

from pyspark.sql import functions as F

from tempora.functions import ids


def py_hash(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode("utf-8")).hexdigest()


def test_phrase_hash_matches_published_example(spark):
    got = spark.range(1).select(ids.phrase_hash(F.lit("moon landing")).alias("h")).first()["h"]
    assert got == py_hash({"phrase": "moon landing"})
    assert got.startswith("09a0c608") and got.endswith("37ae")


def test_escaping_matches_json_text(spark):
    values = ['quote " and \\ backslash', "tab\tnew\nline", "ctrl\x01\x1f\x0b", "ünï ’ ☃", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["h"] for r in frame.select(ids.stable_hash({"context": F.col("v"), "n": F.lit("x")}).alias("h")).collect()]
    assert got == [py_hash({"context": v, "n": "x"}) for v in values]


def test_article_and_embedding_ids(spark):
    row = spark.range(1).select(ids.article_id(F.lit("nyt://a/1")).alias("a"),
                                ids.embedding_id(F.lit("abc"), "pending").alias("e")).first()
    assert row["a"] == py_hash({"source": "nyt", "source_id": "nyt://a/1"})
    assert row["e"] == py_hash({"phrase_hash": "abc", "model_name": "pending"})
