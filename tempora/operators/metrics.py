"""Evaluation metrics over a predictions frame.

Input columns: ``expected_decade`` (nullable), ``top_decade`` (nullable),
``confidence`` (nullable double), ``input_size_group`` (nullable) and
``decades`` — ``array<struct<decade, probability>>`` in decade order (the
6-place rounded distribution).  Only rows with a non-empty expected decade are
labelled; the prediction distribution counts all rows.

Row-level semantics:
* predicted label = ``top_decade`` or the text ``None`` when missing;
* top-1 hit: predicted == expected;
* top-k hit: expected is among the first k decades after a stable sort by
  probability descending (ties keep decade order);
* decade error: |key(predicted) - key(expected)| div 10 (key = digits of the
  label, 0 when none);
* size group: ``input_size_group`` or ``unknown``.

All labelled tables come from one aggregate, :func:`labelled_counts`: a row per
(expected, predicted, size group, top-1 hit, top-k hit) with the number of rows,
the sum of errors and the sum of confidences — as small as the label set.  Every
function takes predictions or that aggregate, so a job that wants several tables
scans its predictions once.  Ratios with a zero denominator are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.distribution import f1, safe_divide
from tempora.functions.timeparts import decade_key

NONE_LABEL = "None"
UNKNOWN_SIZE = "unknown"
#: A pivot by predicted label has one column per label; more than this is refused.
MAX_PIVOT_LABELS = 1000
_DISTRIBUTION = "array<struct<decade:string,probability:double>>"


def _size_group() -> Column:
    """``input_size_group``, or ``unknown`` where it is missing or empty."""
    return F.coalesce(F.nullif(F.col("input_size_group").cast("string"), F.lit("")), F.lit(UNKNOWN_SIZE))


def labelled_rows(predictions: DataFrame, top_k: int = 3) -> DataFrame:
    expected = F.col("expected_decade").cast("string")
    predicted = F.coalesce(F.col("top_decade").cast("string"), F.lit(NONE_LABEL))
    rows = predictions.where(expected.isNotNull() & (expected != "")).select(
        expected.alias("expected"), predicted.alias("predicted"), F.coalesce("decades", F.array().cast(_DISTRIBUTION)).alias("decades"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), _size_group().alias("size_group"))
    # Rank of the expected decade: its place, then one look at all others.  Place and probability are columns of their
    # own, each read more than once, so they are worked out once a row.
    placed = rows.withColumn("_at", F.array_position(F.transform("decades", lambda e: e["decade"]), F.col("expected")).cast("int"))
    own = placed.withColumn("_own", F.get("decades", F.col("_at") - 1)["probability"])
    ahead = F.aggregate(F.transform("decades", lambda e, i: F.when((e["probability"] > F.col("_own")) | ((e["probability"] == F.col("_own")) & (i < F.col("_at") - 1)), 1).otherwise(0)),
                        F.lit(0), lambda n, one: n + one)
    return own.select("expected", "predicted", (F.col("predicted") == F.col("expected")).alias("top1"),
                      ((F.col("_at") > 0) & (ahead < top_k)).alias("topk"), "confidence", "size_group",
                      F.floor(F.abs(decade_key(F.col("predicted")) - decade_key(F.col("expected"))) / 10).cast("bigint").alias("error"))


def labelled_counts(predictions: DataFrame, top_k: int = 3) -> DataFrame:
    """expected, predicted, size_group, top1, topk, n, error_sum, confidence_sum (a frame that is one already is returned)."""
    if {"expected", "n", "error_sum", "confidence_sum"} <= set(predictions.columns):
        return predictions
    return labelled_rows(predictions, top_k).groupBy("expected", "predicted", "size_group", "top1", "topk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("error").alias("error_sum"), F.sum("confidence").alias("confidence_sum"))


def _sum_where(condition: str | None, value: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(F.col(condition), F.col(value)) if condition else F.col(value)), F.lit(0))


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    """Rows per predicted decade over all rows: (top_decade, count)."""
    label = F.coalesce(F.col("top_decade").cast("string"), F.lit(NONE_LABEL))
    return predictions.groupBy(label.alias("top_decade")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def accuracy_summary(predictions: DataFrame, top_k: int = 3) -> DataFrame:
    counts = labelled_counts(predictions, top_k).withColumn("miss", ~F.col("top1"))
    total, hits, near = _sum_where(None), _sum_where("top1"), _sum_where("topk")
    return counts.agg(
        total.cast("bigint").alias("total"),
        hits.cast("bigint").alias("top1_correct"),
        near.cast("bigint").alias("top3_correct"),
        safe_divide(hits, total).alias("top1_accuracy"),
        safe_divide(near, total).alias("top3_accuracy"),
        safe_divide(_sum_where(None, "error_sum"), total).alias("mean_absolute_decade_error"),
        safe_divide(_sum_where("top1", "confidence_sum"), hits).alias("confidence_correct_mean"),
        safe_divide(_sum_where("miss", "confidence_sum"), _sum_where("miss")).alias("confidence_wrong_mean"))


def _rates(counts: DataFrame, key: str, out_key: str, with_confidence: bool) -> DataFrame:
    total, hits, near = _sum_where(None), _sum_where("top1"), _sum_where("topk")
    aggs = [total.cast("bigint").alias("total"), hits.cast("bigint").alias("top1_correct"),
            near.cast("bigint").alias("top3_correct"),
            safe_divide(hits, total).alias("top1_accuracy"), safe_divide(near, total).alias("top3_accuracy")]
    if with_confidence:
        aggs.append(safe_divide(_sum_where(None, "confidence_sum"), total).alias("confidence_mean"))
    return counts.groupBy(F.col(key).alias(out_key)).agg(*aggs)


def rates_by_expected_decade(predictions: DataFrame, top_k: int = 3) -> DataFrame:
    return _rates(labelled_counts(predictions, top_k), "expected", "expected_decade", False)


def rates_by_input_size(predictions: DataFrame, top_k: int = 3) -> DataFrame:
    return _rates(labelled_counts(predictions, top_k), "size_group", "input_size_group", True)


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """(expected_decade, predicted_decade, count) over labelled rows."""
    return (labelled_counts(predictions).groupBy(F.col("expected").alias("expected_decade"),
                                                 F.col("predicted").alias("predicted_decade"))
            .agg(F.sum("n").cast("bigint").alias("count")))


def _labels(counts: DataFrame) -> DataFrame:
    return (counts.select(F.col("expected_decade").alias("label"))
            .union(counts.select(F.col("predicted_decade").alias("label"))).distinct())


def confusion_matrix(predictions: DataFrame, max_labels: int = MAX_PIVOT_LABELS) -> DataFrame:
    """The square matrix over the union of expected and predicted labels in long, dense form: (expected, predicted,
    count), 0 where a pair never occurs.  More labels than ``max_labels`` are an error, none is left out."""
    counts = confusion_counts(predictions)
    # A matrix has labels x labels cells, so their number is checked before it is unfolded.
    if _labels(counts).limit(max_labels + 1).count() > max_labels:
        raise ValueError(f"more than {max_labels} labels: use confusion_counts")
    # One row with the array of labels, unfolded to both sides: as many rows as the matrix has cells.
    cells = (_labels(counts).agg(F.collect_set("label").alias("labels"))
             .select(F.explode("labels").alias("expected"), "labels").select("expected", F.explode("labels").alias("predicted")))
    found = counts.select(F.col("expected_decade").alias("expected"), F.col("predicted_decade").alias("predicted"), "count")
    return cells.join(found, ["expected", "predicted"], "left").select(
        "expected", "predicted", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def confusion_pivot(predictions: DataFrame, max_labels: int = MAX_PIVOT_LABELS) -> DataFrame:
    """The matrix as a table for people: one row and one column per label, in decade order.  More labels than
    ``max_labels`` are an error, none is left out."""
    cells = confusion_matrix(predictions, max_labels)
    rows = cells.select("expected").distinct().orderBy(decade_key(F.col("expected")), "expected").collect()
    return cells.groupBy("expected").pivot("predicted", [r["expected"] for r in rows]).agg(F.sum("count"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Per class (union of expected and predicted labels): support, predicted,
    true/false positives, false negatives, precision, recall, F1, correct,
    errors and the confused-with list ``decade: n, ...`` ordered by count desc
    then decade."""
    counts = confusion_counts(predictions)
    e, p, n = F.col("expected_decade"), F.col("predicted_decade"), F.col("count")
    roles = F.array(
        F.struct(e.alias("label"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(e == p, n).otherwise(0).cast("bigint").alias("tp"),
                 F.when(e != p, F.struct((-n).alias("neg"), decade_key(p).alias("k"), p.alias("d"), n.alias("n")))
                 .alias("confused")),
        F.struct(p.alias("label"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp"),
                 F.lit(None).cast("struct<neg:bigint,k:bigint,d:string,n:bigint>").alias("confused")))
    exploded = counts.select(F.inline(roles))
    per_class = exploded.groupBy(F.col("label").alias("decade")).agg(
        F.sum("support").cast("bigint").alias("support"),
        F.sum("predicted").cast("bigint").alias("predicted"),
        F.sum("tp").cast("bigint").alias("true_positives"),
        F.array_sort(F.collect_list("confused")).alias("_confused"))
    tp, support, predicted = F.col("true_positives"), F.col("support"), F.col("predicted")
    precision = safe_divide(tp, predicted)
    recall = safe_divide(tp, support)
    confused = F.array_join(F.transform("_confused", lambda c: F.concat(c["d"], F.lit(": "),
                                                                        c["n"].cast("string"))), ", ")
    return per_class.select(
        "decade", "support", "predicted", precision.alias("precision"), recall.alias("recall"),
        f1(precision, recall).alias("f1_score"), "true_positives",
        (predicted - tp).alias("false_positives"), (support - tp).alias("false_negatives"),
        tp.alias("correct"), (support - tp).alias("errors"), confused.alias("confused_with"))


def classification_summary(predictions: DataFrame) -> DataFrame:
    """Macro (plain mean over classes), weighted (by support) and micro
    (true positives / total) precision, recall and F1."""
    report = classification_report(predictions)
    total = F.sum("support")
    micro = safe_divide(F.sum("true_positives"), total)
    return report.agg(
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg("f1_score"), F.lit(0.0)).alias("macro_f1_score"),
        safe_divide(F.sum(F.col("precision") * F.col("support")), total).alias("weighted_precision"),
        safe_divide(F.sum(F.col("recall") * F.col("support")), total).alias("weighted_recall"),
        safe_divide(F.sum(F.col("f1_score") * F.col("support")), total).alias("weighted_f1_score"),
        micro.alias("micro_precision"), micro.alias("micro_recall"), micro.alias("micro_f1_score"))


def sample_summary(predictions: DataFrame) -> DataFrame:
    """Totals of a sample run: inputs, directed, random, directed matches."""
    group = F.col("group")
    return predictions.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_inputs"),
        F.count_if(group == "directed").cast("bigint").alias("directed_inputs"),
        F.count_if(group == "random").cast("bigint").alias("random_inputs"),
        F.count_if((group == "directed") & F.coalesce(F.col("matches_expected"), F.lit(False)))
        .cast("bigint").alias("directed_matches"))


def inputs_by_size(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(_size_group().alias("input_size_group")).agg(F.count(F.lit(1)).cast("bigint").alias("inputs"))
