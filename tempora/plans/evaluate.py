"""Evaluation runs and run comparison.

``run_evaluation`` scores an input set with a model, computes every metric
table and writes them under ``<output>/<table>/run_id=<id>/`` (a folder is
replaced as a whole, so re-running a run id replaces only that run), plus the
predictions as JSON lines, the confusion matrix and the classification report
as CSV, and a row in the ``runs`` table (the latest run is the one with the
highest number).

``compare_runs`` puts the headline metrics of several runs side by side and
pivots their prediction distributions by run.
"""

from __future__ import annotations

import datetime as _dt
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.timeparts import decade_key
from tempora.models import profile as profile_model
from tempora.operators import metrics
from tempora.session import shared_table
from tempora.sources.datasets import dataset_exists
from tempora.sources.jsonl import read_inputs, write_predictions_jsonl

METRIC_TABLES = ("accuracy", "rates_by_decade", "rates_by_size", "confusion", "classification_report",
                 "classification_summary", "prediction_distribution")


def load_model(spark: SparkSession, model_type: str, path: str | None = None):
    """A model by its type: ``profile`` (the uniform fallback when there is none at ``path``) or ``tfidf``."""
    from tempora.models.tfidf import TfidfModel

    if model_type == "profile":
        if path is None or not dataset_exists(spark, path, "prior"):
            return profile_model.ProfileModel.fallback(spark)
        return profile_model.ProfileModel.load(spark, path)
    if model_type == "tfidf":
        if path is None or not dataset_exists(spark, path, "decades"):
            raise FileNotFoundError(f"no TF-IDF model at {path}: train one first")
        return TfidfModel.load(spark, path)
    raise ValueError(f"unknown model type {model_type!r}: profile or tfidf")


def predict(spark: SparkSession, inputs: DataFrame, model=None) -> DataFrame:
    """Prediction rows for an input frame (``id, phrase`` ...) with a profile
    model, a TF-IDF model, or the uniform fallback when ``model`` is None."""
    from tempora.models.tfidf import TfidfModel, score_phrases as tfidf_scores

    if model is None:
        model = profile_model.ProfileModel.fallback(spark)
    scores = tfidf_scores if isinstance(model, TfidfModel) else profile_model.score_phrases
    return profile_model.prediction_table(inputs, scores(model, inputs))


def metric_tables(predictions: DataFrame, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every metric table; the labelled ones read one aggregate (``counts``, or made in one scan)."""
    if counts is None:
        counts = shared_table(metrics.labelled_counts(predictions), "labelled_counts")
    return {
        "accuracy": metrics.accuracy_summary(counts),
        "rates_by_decade": metrics.rates_by_expected_decade(counts),
        "rates_by_size": metrics.rates_by_input_size(counts),
        "confusion": metrics.confusion_counts(counts),
        "classification_report": metrics.classification_report(counts),
        "classification_summary": metrics.classification_summary(counts),
        "prediction_distribution": metrics.prediction_distribution(predictions),
    }


def _run_path(output_dir: str, table: str, run_id: str) -> str:
    return f"{output_dir.rstrip('/')}/{table}/run_id={run_id}"


def run_evaluation(spark: SparkSession, input_path: str, output_dir: str, model=None, run_id: str | None = None,
                   model_type: str | None = None, model_path: str | None = None) -> str:
    """Score the inputs and store the run.  Without a ``model`` the one of ``model_type`` (``profile`` by default) at
    ``model_path`` is loaded: an absent profile is the uniform fallback, an absent TF-IDF model an error."""
    own_type = None if model is None else "profile" if isinstance(model, profile_model.ProfileModel) else "tfidf"
    if own_type and model_type not in (None, own_type):
        raise ValueError(f"the model is of type {own_type}, not {model_type}")
    model_type = own_type or model_type or "profile"
    model = load_model(spark, model_type, model_path) if model is None else model
    return store_run(predict(spark, read_inputs(spark, input_path), model), output_dir, run_id, model_type, input_path)


def store_run(predictions: DataFrame, output_dir: str, run_id: str | None = None, model_type: str = "profile", source: str = "") -> str:
    """Write predictions and all metric tables of a run, then its row in ``runs``: a run counts once that row is there."""
    spark = predictions.sparkSession
    run_id = run_id or _dt.datetime.now().strftime("%Y%m%d-%H%M%S")
    base = output_dir.rstrip("/")

    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"a run id has letters, digits, dots, hyphens and underscores: {run_id!r}")

    def of_run(name: str) -> DataFrame:
        return spark.read.parquet(_run_path(base, name, run_id))

    # The folder of the run is written whole, so a run without rows replaces an earlier one of its id too.  Predictions
    # are written once (they are an output) and every metric table reads them back instead of re-scoring the inputs.
    predictions.write.mode("overwrite").parquet(_run_path(base, "prediction_rows", run_id))
    written = of_run("prediction_rows")
    write_predictions_jsonl(written, f"{base}/predictions/run_id={run_id}")
    counts = shared_table(metrics.labelled_counts(written), "labelled_counts")
    for name, table in metric_tables(written, counts).items():
        table.write.mode("overwrite").parquet(_run_path(base, name, run_id))

    matrix = metrics.confusion_pivot(counts).withColumnRenamed("expected", "expected\\predicted")
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/confusion_matrix/run_id={run_id}")
    # The report, the summary and the headline numbers as JSON, a line per row.
    for name in ("classification_report", "classification_summary", "accuracy"):
        of_run(name).coalesce(1).write.mode("overwrite").json(f"{base}/{name}_json/run_id={run_id}")
    report = of_run("classification_report").orderBy(decade_key(F.col("decade")), "decade").select(
        "decade", "support", F.format_string("%.6f", "precision").alias("precision"),
        F.format_string("%.6f", "recall").alias("recall"), F.format_string("%.6f", "f1_score").alias("f1_score"),
        "correct", "errors", "confused_with")
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(
        f"{base}/classification_report_csv/run_id={run_id}")
    # Runs are numbered, so the latest one doesn't hang on a clock.
    number = 1
    if dataset_exists(spark, base, "runs"):
        number += spark.read.parquet(f"{base}/runs").agg(F.max("number")).first()[0]
    runs = spark.createDataFrame([(run_id, number, model_type, _dt.datetime.now(_dt.timezone.utc).isoformat(), source)],
                                 "run_id string, number long, model_type string, created_at string, input_path string")
    runs.coalesce(1).write.mode("append").parquet(f"{base}/runs")
    return run_id


def latest_run(spark: SparkSession, output_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{output_dir.rstrip('/')}/runs")
    return runs.agg(F.max_by("run_id", "number").alias("run_id"))


def compare_runs(spark: SparkSession, output_dir: str, run_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(headline metrics per run, prediction distribution: decade x run) of stored runs."""
    base = output_dir.rstrip("/")
    stored = spark.read.parquet(f"{base}/runs").select("run_id").distinct()
    missing = set(run_ids) - {r.run_id for r in stored.where(F.col("run_id").isin(*run_ids)).collect()}
    if missing:
        raise ValueError(f"no such runs: {sorted(missing)}")

    def of_runs(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (spark.read.parquet(_run_path(base, name, run)).withColumn("run_id", F.lit(run)) for run in run_ids))

    headline = of_runs("accuracy").join(of_runs("classification_summary"), "run_id").select(
        "run_id", "total", "top1_accuracy", "top3_accuracy", "mean_absolute_decade_error", "macro_f1_score",
        "weighted_f1_score", "confidence_correct_mean", "confidence_wrong_mean")
    dist = of_runs("prediction_distribution").groupBy("top_decade").pivot("run_id", run_ids).agg(F.sum("count")).na.fill(0)
    return headline, dist
