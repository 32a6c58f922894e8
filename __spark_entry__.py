"""

Every registered query reads the provided tables (or data Spark derives from
them) in full; see ``tempora/sources/corpora.py`` for the corpora C1 (dated
documents), C2 (dated phrase occurrences from orders) and C3 (labelled
predictions derived from orders).  Doubles are rounded to 10 places at this
edge only, on both sides of the comparison.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tempora.functions import ids, text  # noqa: E402
from tempora.functions.distribution import softmax_array, top_of_array  # noqa: E402
from tempora.functions.sizes import input_size  # noqa: E402
from tempora.functions.timeparts import decade_of_year  # noqa: E402
from tempora.models import profile as profile_model  # noqa: E402
from tempora.models import tfidf as tfidf_model  # noqa: E402
from tempora.operators import corpus, embeddings, features, inspect, metrics, phrases, sampling  # noqa: E402
from tempora.operators import timelines, validation  # noqa: E402
from tempora.operators.ingest import articles_with_text, phrases_of_articles  # noqa: E402
from tempora.plans import evaluate  # noqa: E402
from tempora.session import scratch_folder, shared_table  # noqa: E402
from tempora.sources import corpora  # noqa: E402
from tempora.sources.archive import articles_from_archive, write_archive  # noqa: E402
from tempora.sources.datasets import read_dataset, write_partitioned  # noqa: E402
from tempora.sources.jsonl import parse_inputs, read_training_jsonl, write_training_jsonl  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _r10(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*[F.round(F.col(c), 10).alias(c) if c in columns else F.col(c) for c in frame.columns])


# ---------------------------------------------------------------------------
# C1: documents as dated articles
# ---------------------------------------------------------------------------
def c1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.table(spark, sf_dir, "documents")
    norm = text.normalize_text(F.col("text"))
    return docs.select("doc_id", F.length(norm).alias("n_chars"),
                       F.size(text.tokenize(F.col("text"))).alias("n_tokens"),
                       F.sha2(norm, 256).alias("normalized_hash"))


def c1_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.c1_articles(spark, sf_dir).drop("doc_id", "text")


def _phrases(articles: DataFrame, max_phrases: int | None = None) -> DataFrame:
    found = phrases.extract_phrases(articles, "doc_id", "text", carry=["year", "month", "decade"], max_phrases=max_phrases,
                                    partitions=corpora.spread(articles))
    return found.withColumn("phrase_hash", ids.phrase_hash(F.col("phrase")))


def c1_phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(corpora.c1_articles(spark, sf_dir))


def c1_top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each document's 300 most frequent phrases."""
    return _phrases(corpora.c1_articles(spark, sf_dir), max_phrases=300)


def c1_phrases_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every second one again under the id of another one: rows that share an id stay apart."""
    docs = corpora.table(spark, sf_dir, "documents")
    again = docs.where("doc_id % 2 = 1").withColumn("doc_id", F.floor(F.col("doc_id") / 2).cast("bigint"))
    return _phrases(corpora.articles_from_documents(docs.unionByName(again)))


def _c1_uncontexted(spark: SparkSession, sf_dir: str, per_row: bool = False) -> DataFrame:
    articles = corpora.c1_articles(spark, sf_dir)
    return phrases.extract_phrases(articles, "doc_id", "text", carry=["year"], context_radius=None,
                                   partitions=corpora.spread(articles), per_row=per_row)


#: Texts beyond so many characters are counted by slices in ``c1_phrases_sliced``: nearly every document is cut.
SLICE_CHARS = 400


def c1_phrases_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of every row (ids repeat, as in ``c1_phrases_repeated``), long texts by slices."""
    docs = corpora.table(spark, sf_dir, "documents")
    again = docs.where("doc_id % 2 = 1").withColumn("doc_id", F.floor(F.col("doc_id") / 2).cast("bigint"))
    found = phrases.extract_phrases(corpora.articles_from_documents(docs.unionByName(again)), "doc_id", "text",
                                    carry=["year", "month", "decade"], context_radius=None, long_chars=SLICE_CHARS)
    return found.withColumn("phrase_hash", ids.phrase_hash(F.col("phrase")))


def c1_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a phrase follow each other, so a file that holds them repeats the phrase and its hash in place."""
    found = timelines.phrase_timelines(_c1_uncontexted(spark, sf_dir)).sortWithinPartitions("phrase", "year")
    return _r10(timelines.with_phrase_hash(found), "normalized_frequency")


def c1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(timelines.with_phrase_hash(timelines.phrase_statistics(_c1_uncontexted(spark, sf_dir))), "temporal_entropy")


def _c1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(timelines.phrase_timelines(_c1_uncontexted(spark, sf_dir)), min_count=2).drop("phrase_head")


def c1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(timelines.with_phrase_hash(_c1_features(spark, sf_dir)), "temporal_entropy", "decade_score", "target_probability")


def c1_inspect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target decades of every phrase with features, asked in capitals; C1 has 12 decades, so the first five are a part."""
    found = timelines.with_phrase_hash(shared_table(_c1_features(spark, sf_dir), "features"))
    asked = found.select(F.upper("phrase").alias("phrase"))
    return _r10(inspect.inspect_targets(asked, found), "target_probability", "decade_score")


def c1_corpus_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_distribution(articles=corpora.c1_articles(spark, sf_dir),
                                      phrases=_c1_uncontexted(spark, sf_dir, per_row=True).withColumn("decade", decade_of_year(F.col("year"))))


def c1_sampled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = sampling.sample_articles(corpora.c1_articles(spark, sf_dir))
    return sampled.groupBy("year", "month").agg(F.count(F.lit(1)).cast("bigint").alias("articles"))


def c1_input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.table(spark, sf_dir, "documents")
    size = input_size(F.col("text"))
    return docs.select("doc_id", size["token_count"].alias("token_count"), size["char_count"].alias("char_count"),
                       size["group"].alias("input_size_group"), size["over_90_chars"].alias("over_90_chars"))


# ---------------------------------------------------------------------------
# C2: phrase occurrences from orders
# ---------------------------------------------------------------------------
def c2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.c2_phrases(spark, sf_dir)


def c2_yearly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.yearly_totals(c2_phrases(spark, sf_dir))


def _c2_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.phrase_timelines(c2_phrases(spark, sf_dir))


def c2_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(_c2_timelines(spark, sf_dir), "normalized_frequency")


def c2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(timelines.phrase_statistics(c2_phrases(spark, sf_dir)), "temporal_entropy")


def c2_ranked_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.ranked_years(_c2_timelines(spark, sf_dir))


def c2_ranked_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.ranked_decades(_c2_timelines(spark, sf_dir))


def _c2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(_c2_timelines(spark, sf_dir), min_count=2)


def c2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(_c2_features(spark, sf_dir), "temporal_entropy", "decade_score", "target_probability")


def _c2_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored: its decades are read first, then its rows.
    return features.training_set(shared_table(_c2_features(spark, sf_dir), "features"))


def c2_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _c2_training(spark, sf_dir)
    target = F.col("target")
    return _r10(train.select(
        "phrase", "phrase_hash", "features.*",
        F.array_join(F.map_keys(target), ",").alias("target_decades"),
        F.aggregate(F.map_values(target), F.lit(0.0), lambda a, v: a + v).alias("target_sum")),
        "temporal_entropy", "target_sum")


def c2_training_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set exported as JSON lines in phrase order and read back, a row for each probability."""
    path = scratch_folder(spark, "training-jsonl")
    write_training_jsonl(_c2_training(spark, sf_dir), path)
    rows = read_training_jsonl(spark, path).select("phrase", "phrase_hash", "features.*", F.explode("target").alias("decade", "probability"))
    return _r10(rows, "temporal_entropy", "probability")


def c2_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of each phrase's decade scores, and the decade on top."""
    found = _c2_features(spark, sf_dir)
    # At most one entry a decade.
    scores = found.groupBy("phrase_hash").agg(F.sort_array(F.collect_list(F.struct("decade", F.col("decade_score").alias("probability")))).alias("s"))
    soft = scores.withColumn("d", softmax_array(F.col("s"))).withColumn("top", top_of_array(F.col("d")))
    return _r10(soft.select("phrase_hash", F.col("top.decade").alias("top_decade"), F.inline("d")), "probability")


def c2_target_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.target_census(_c2_training(spark, sf_dir))


def c2_target_census_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(corpus.target_census_summary(_c2_training(spark, sf_dir)), "ratio_most_least")


def _c2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.phrase_statistics(c2_phrases(spark, sf_dir))


def c2_embedding_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_manifest(_c2_statistics(spark, sf_dir))


def c2_real_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = embeddings.embedding_manifest(_c2_statistics(spark, sf_dir))
    found = embeddings.generate_embeddings(manifest, "hashed-trigram-64")
    at = F.filter(F.transform("embedding", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    weighted = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * i), F.lit(0.0), lambda acc, v: acc + v)
    return found.select("phrase_hash", "phrase", "model_name", "embedding_id", "embedding_status",
                        F.size("embedding").alias("dimension"), F.size(at).alias("used_buckets"),
                        F.array_join(at.cast("array<string>"), ",").alias("buckets"),
                        F.round(total, 4).alias("total"), F.round(weighted, 3).alias("weighted_total"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked phrases: every part name, as written and upper-cased with noise."""
    part = corpora.table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("phrase")).union(
        part.select(F.concat(F.upper("p_name"), F.lit("!!")).alias("phrase")))


def c2_inspect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(inspect.inspect_targets(_asked(spark, sf_dir), _c2_features(spark, sf_dir)),
                "target_probability", "decade_score")


def c2_inspect_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(inspect.inspect_timeline(_asked(spark, sf_dir), _c2_timelines(spark, sf_dir)),
                "normalized_frequency")


def c2_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _c2_timelines(spark, sf_dir)
    return corpus.dataset_counts({
        "phrases": c2_phrases(spark, sf_dir),
        "phrase_timelines": found,
        "phrase_statistics": _c2_statistics(spark, sf_dir),
        "features": features.build_features(found, min_count=2),
        "embeddings": c2_embedding_manifest(spark, sf_dir),
    })


def c2_corpus_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(corpus.corpus_distribution(phrases=c2_phrases(spark, sf_dir), features=_c2_features(spark, sf_dir)),
                "value")


def _c2_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring inputs derived from every part: the name, the name with its type,
    the type alone, or the name upper-cased with punctuation."""
    part = corpora.table(spark, sf_dir, "part")
    part = part.repartition(corpora.parts_of(part))
    variant = F.col("p_size") % 4
    phrase = (F.when(variant == 0, F.col("p_name"))
              .when(variant == 1, F.concat_ws(" ", "p_name", F.lower("p_type")))
              .when(variant == 2, F.lower("p_type"))
              .otherwise(F.concat(F.upper("p_name"), F.lit("!!"))))
    expected = F.when(F.col("p_size") % 3 == 0, "1990s").when(F.col("p_size") % 3 == 1, "2000s")
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
                       phrase.alias("phrase"), expected.alias("expected_decade"))


def c2_phrase_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _c2_inputs(spark, sf_dir).select("phrase").distinct()
    feats = text.with_phrase_features(inputs, "phrase", "f")
    return feats.select("phrase", F.size("f").alias("n_features"),
                        F.sha2(F.array_join("f", "|"), 256).alias("features_hash"))


def _c2_model(spark: SparkSession, sf_dir: str, balanced: bool = False) -> profile_model.ProfileModel:
    return profile_model.fit_profile(shared_table(_c2_training(spark, sf_dir), "training"), balance_decades=balanced)


def c2_profile_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(_c2_model(spark, sf_dir).prior, "prior")


def c2_profile_prior_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(_c2_model(spark, sf_dir, balanced=True).prior, "prior")


def c2_profile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(_c2_model(spark, sf_dir).weights, "weight")


def c2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(_c2_model(spark, sf_dir).profile, "probability")


def c2_profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = profile_model.score_profile(_c2_model(spark, sf_dir), _c2_inputs(spark, sf_dir))
    return _r10(scored.select("id", F.inline_outer("decades")), "probability")


def _c1_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored: its decades are read first, then its rows.
    return features.training_set(shared_table(_c1_features(spark, sf_dir), "features"))


# A documented bound on the rows of ``c1_tfidf_sample`` and ``c1_tfidf_properties`` (chosen by hash).
TFIDF_TRAINING_ROWS = 5000


C1_MIN_FEATURE_WEIGHT = 5.0


def c1_profile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut-off that leaves out most features of C1."""
    rows = shared_table(_c1_training(spark, sf_dir), "training")
    weights = profile_model.fit_profile(rows, min_feature_weight=C1_MIN_FEATURE_WEIGHT).weights
    return weights.withColumn("weight", F.round("weight", 4))


def c1_tfidf_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r10(tfidf_model.gram_statistics(tfidf_model.labelled_grams(_c1_training(spark, sf_dir))), "idf")


def c1_tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a classifier that is fitted to all training rows."""
    model = tfidf_model.fit_tfidf(_c1_training(spark, sf_dir))
    scored = tfidf_model.score_tfidf(model, _c2_inputs(spark, sf_dir))
    return scored.select("id", F.inline_outer("decades"))


def c1_tfidf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that fit the classifier, with their labels."""
    return tfidf_model.target_labels(tfidf_model.training_sample(shared_table(_c1_training(spark, sf_dir), "training"), TFIDF_TRAINING_ROWS))


def c1_tfidf_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the classifier's scores, whatever the optimizer: one row a property."""
    # Stored: the fit, the scores and three properties read the sample.
    training = shared_table(tfidf_model.training_sample(shared_table(_c1_training(spark, sf_dir), "training"), TFIDF_TRAINING_ROWS), "sample")
    model = tfidf_model.fit_tfidf(training)
    labels = tfidf_model.target_labels(training)
    scored = shared_table(tfidf_model.score_tfidf(model, _c2_inputs(spark, sf_dir).select("id", "phrase").unionByName(labels.select(F.concat(F.lit("T:"), "phrase").alias("id"), "phrase"))), "scores")
    cells = scored.select("id", F.inline_outer("decades"))
    per_input = cells.groupBy("id").agg(F.count("decade").alias("cells"), F.count_distinct("decade").alias("decades"), F.sum("probability").alias("total"))
    # The mean loss on the rows it was fitted to must be below that of their label frequencies.
    known = cells.join(labels.select(F.concat(F.lit("T:"), "phrase").alias("id"), F.col("label").alias("decade")), ["id", "decade"])
    rows = Window.partitionBy(F.lit(1))
    prior = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(rows))
    loss = known.agg(F.avg(-F.log(F.greatest("probability", F.lit(1e-12)))).alias("loss"))
    prior_loss = prior.agg((-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("prior_loss"))
    best = cells.where("id LIKE 'T:%'").groupBy("id").agg(F.max_by("decade", "probability").alias("best"))
    hits = best.join(labels.select(F.concat(F.lit("T:"), "phrase").alias("id"), "label"), "id").agg(F.avg((F.col("best") == F.col("label")).cast("double")).alias("share"))

    def row(name: str, frame: DataFrame, value) -> DataFrame:
        return frame.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("property"), "value")

    found = [row("inputs", per_input, F.count(F.lit(1))), row("cells", per_input, F.sum("cells")), row("uneven", per_input, F.count_if(F.col("cells") != F.col("decades"))),
             row("sums_off", per_input, F.count_if(F.abs(F.col("total") - 1) > 1e-6)), row("outside", cells, F.count_if(~F.col("probability").between(0, 1))),
             row("no_better_than_frequencies", loss.join(F.broadcast(prior_loss), F.col("loss") >= F.col("prior_loss")), F.count(F.lit(1))),
             row("half_of_training_rows_missed", hits, F.count_if(F.col("share") < 0.5))]
    return reduce(DataFrame.unionAll, found)


def _validation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input set from every part: the name as id (names repeat), the type
    as phrase, and a decade from the size that is sometimes out of range."""
    part = corpora.table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("id"), F.lower("p_type").alias("phrase"),
                       F.concat((F.lit(1850) + (F.col("p_size") % 20) * 10).cast("string"), F.lit("s"))
                       .alias("expected_decade"))


VALIDATION_MIN_PER_DECADE = 100


def c2_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_errors(_validation_inputs(spark, sf_dir), require_expected=True,
                                        min_per_decade=VALIDATION_MIN_PER_DECADE)


def c2_validation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of an input set in which ids, phrases or decades are null or empty in some rows."""
    rows, size = _validation_inputs(spark, sf_dir).withColumn("n", F.length("id") + F.length("phrase")), F.length("phrase")

    def gaps(name: str, null: int, empty: int):
        return F.when(F.col("n") % 7 == null, None).when(size % 7 == empty, "").otherwise(F.col(name)).alias(name)

    gapped = rows.select(gaps("id", 1, 2), gaps("phrase", 3, 4), gaps("expected_decade", 5, 6))
    return validation.validation_errors(gapped, require_expected=True)


def c2_validation_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.decade_counts(_validation_inputs(spark, sf_dir))


def c2_validation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.size_counts(_validation_inputs(spark, sf_dir))


def c2_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_summary(_validation_inputs(spark, sf_dir), require_expected=True,
                                         min_per_decade=VALIDATION_MIN_PER_DECADE)


def c2_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every input, and every one but P1 again under the id of the one before: ids repeat, phrases differ."""
    inputs = _c2_inputs(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("bigint")
    inputs = inputs.unionByName(inputs.where(number != 1).withColumn("id", F.concat(F.lit("P"), (number - 1).cast("string"))))
    found = profile_model.prediction_table(inputs, profile_model.score_phrases(_c2_model(spark, sf_dir), inputs))
    millionths = F.transform("decades", lambda e: F.concat(e["decade"], F.lit(":"), F.round(e["probability"] * 1000000).cast("bigint").cast("string")))
    return found.withColumn("decades", F.array_join(millionths, ","))


# ---------------------------------------------------------------------------
# C3: labelled predictions from orders -> evaluation metrics
# ---------------------------------------------------------------------------
def _c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.c3_predictions(spark, sf_dir)


def c3_prediction_distribution(spark, sf_dir):
    return metrics.prediction_distribution(_c3(spark, sf_dir))


def c3_accuracy(spark, sf_dir):
    return _r10(metrics.accuracy_summary(_c3(spark, sf_dir)), "top1_accuracy", "top3_accuracy",
                "mean_absolute_decade_error", "confidence_correct_mean", "confidence_wrong_mean")


def c3_rates_by_decade(spark, sf_dir):
    return _r10(metrics.rates_by_expected_decade(_c3(spark, sf_dir)), "top1_accuracy", "top3_accuracy")


def c3_rates_by_size(spark, sf_dir):
    return _r10(metrics.rates_by_input_size(_c3(spark, sf_dir)), "top1_accuracy", "top3_accuracy",
                "confidence_mean")


def c3_confusion(spark, sf_dir):
    return metrics.confusion_counts(_c3(spark, sf_dir))


def c3_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_c3(spark, sf_dir))


def _two_runs(spark: SparkSession, sf_dir: str) -> str:
    """The folder of two stored runs: all predictions, and those of odd orders (written twice: the second time replaces the first)."""
    predictions, out = _c3(spark, sf_dir), scratch_folder(spark, "runs")
    evaluate.store_run(predictions.limit(0), out, "odd")
    evaluate.store_run(predictions, out, "all")
    evaluate.store_run(predictions.where(F.col("id").cast("bigint") % 2 == 1), out, "odd")
    return out


def c3_run_comparison(spark, sf_dir):
    """Two stored runs side by side, and which is the latest."""
    out = _two_runs(spark, sf_dir)
    headline, _ = evaluate.compare_runs(spark, out, ["all", "odd"])
    rates = ("top1_accuracy", "top3_accuracy", "mean_absolute_decade_error", "macro_f1_score", "weighted_f1_score")
    latest = evaluate.latest_run(spark, out).withColumnRenamed("run_id", "latest_id")
    headline = headline.join(F.broadcast(latest), headline["run_id"] == latest["latest_id"], "left")
    return _r10(headline.select("run_id", "total", *rates, F.col("latest_id").isNotNull().alias("latest")), *rates)


def c3_run_distribution(spark, sf_dir):
    """Predicted decades of two stored runs, a column a run."""
    return evaluate.compare_runs(spark, _two_runs(spark, sf_dir), ["all", "odd"])[1].withColumnsRenamed({"all": "all_rows", "odd": "odd_rows"})


def c3_classification_report(spark, sf_dir):
    return _r10(metrics.classification_report(_c3(spark, sf_dir)), "precision", "recall", "f1_score")


def c3_classification_summary(spark, sf_dir):
    frame = metrics.classification_summary(_c3(spark, sf_dir))
    return _r10(frame, *frame.columns)


def c3_sample_summary(spark, sf_dir):
    return metrics.sample_summary(_c3(spark, sf_dir))


def c3_inputs_by_size(spark, sf_dir):
    return metrics.inputs_by_size(_c3(spark, sf_dir))


# ---------------------------------------------------------------------------
# C4: documents as archive records, parts as an input file
# ---------------------------------------------------------------------------
def _c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = corpora.archive_from_documents(corpora.table(spark, sf_dir, "documents"))
    return articles_from_archive(records, start_year=1905, end_year=2010, source="documents")


def c4_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(_c4(spark, sf_dir))


def _digested(articles: DataFrame) -> DataFrame:
    return articles.withColumn("text", F.sha2("text", 256))


def c4_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 written as archive files (one a month), and the first half of each year from 1905 to 2010 read from them."""
    root = scratch_folder(spark, "archive")
    write_archive(corpora.archive_from_documents(corpora.table(spark, sf_dir, "documents")), root)
    return _digested(articles_with_text(spark, root, 1905, 2010, months=range(1, 7), source="documents"))


def c4_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of C4 written by months; March and April written again with a part of their rows; all months read."""
    root, articles = scratch_folder(spark, "rewritten"), _digested(_c4(spark, sf_dir))
    write_partitioned(articles, root, "articles", sort_by="article_id")
    again = articles.where("month IN (3, 4) AND word_count % 2 = 0").withColumn("section", F.lit("again"))
    write_partitioned(again, root, "articles", sort_by="article_id")
    return read_dataset(spark, root, "articles", columns=articles.columns, required=True)


def c4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = _c4(spark, sf_dir)
    return phrases_of_articles(articles, partitions=corpora.spread(articles))


def c4_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_inputs(corpora.input_lines_from_part(corpora.table(spark, sf_dir, "part")))
    return rows.select("id", "phrase", "expected_decade")


# ---------------------------------------------------------------------------
# ---------------------------------------------------------------------------
def entry(spark: SparkSession) -> DataFrame:
    """Flagship: peak year, peak decade and temporal entropy of every phrase
    extracted from the documents corpus (C1) at sf0.001."""
    return c1_statistics(spark, SMOKE_DIR)


def _llm():
    """The queries of the subpackage ``llm`` and of the pipeline, or None where they can't be imported."""
    try:
        import corpus_pipeline
        from tempora.llm import queries as llm_queries
    except ImportError:
        return None
    return llm_queries, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _own_queries()
    if llm := _llm():
        found |= llm[0].QUERIES | {"pipeline": llm[1].run}
    return found


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "c1_normalized": c1_normalized,
        "c1_articles": c1_articles,
        "c1_phrases": c1_phrase_rows,
        "c1_top_phrases": c1_top_phrases,
        "c1_phrases_repeated": c1_phrases_repeated,
        "c1_phrases_sliced": c1_phrases_sliced,
        "c1_timelines": c1_timelines,
        "c1_statistics": c1_statistics,
        "c1_features": c1_features,
        "c1_inspect_targets": c1_inspect_targets,
        "c1_corpus_distribution": c1_corpus_distribution,
        "c1_sampled_articles": c1_sampled_articles,
        "c1_input_sizes": c1_input_sizes,
        "c2_phrases": c2_phrases,
        "c2_yearly_totals": c2_yearly_totals,
        "c2_timelines": c2_timelines,
        "c2_statistics": c2_statistics,
        "c2_ranked_years": c2_ranked_years,
        "c2_ranked_decades": c2_ranked_decades,
        "c2_features": c2_features,
        "c2_training_set": c2_training_set,
        "c2_training_exchange": c2_training_exchange,
        "c2_softmax": c2_softmax,
        "c2_target_census": c2_target_census,
        "c2_target_census_summary": c2_target_census_summary,
        "c2_embedding_manifest": c2_embedding_manifest,
        "c2_real_embeddings": c2_real_embeddings,
        "c2_inspect_targets": c2_inspect_targets,
        "c2_inspect_timeline": c2_inspect_timeline,
        "c2_dataset_counts": c2_dataset_counts,
        "c2_corpus_distribution": c2_corpus_distribution,
        "c2_phrase_features": c2_phrase_features,
        "c2_profile_prior": c2_profile_prior,
        "c2_profile_prior_balanced": c2_profile_prior_balanced,
        "c2_profile_weights": c2_profile_weights,
        "c2_profile": c2_profile,
        "c2_profile_scores": c2_profile_scores,
        "c2_predictions": c2_predictions,
        "c1_profile_weights": c1_profile_weights,
        "c1_tfidf_grams": c1_tfidf_grams,
        "c1_tfidf_scores": c1_tfidf_scores,
        "c1_tfidf_sample": c1_tfidf_sample,
        "c1_tfidf_properties": c1_tfidf_properties,
        "c2_validation_errors": c2_validation_errors,
        "c2_validation_gaps": c2_validation_gaps,
        "c2_validation_decades": c2_validation_decades,
        "c2_validation_sizes": c2_validation_sizes,
        "c2_validation_summary": c2_validation_summary,
        "c3_prediction_distribution": c3_prediction_distribution,
        "c3_accuracy": c3_accuracy,
        "c3_rates_by_decade": c3_rates_by_decade,
        "c3_rates_by_size": c3_rates_by_size,
        "c3_confusion": c3_confusion,
        "c3_confusion_matrix": c3_confusion_matrix,
        "c4_articles": c4_articles,
        "c4_archive": c4_archive,
        "c4_rewritten": c4_rewritten,
        "c4_phrases": c4_phrases,
        "c4_inputs": c4_inputs,
        "c3_run_comparison": c3_run_comparison,
        "c3_run_distribution": c3_run_distribution,
        "c3_classification_report": c3_classification_report,
        "c3_classification_summary": c3_classification_summary,
        "c3_sample_summary": c3_sample_summary,
        "c3_inputs_by_size": c3_inputs_by_size,
    }


def oracle_sql() -> dict[str, str]:
    from sql_oracles import ORACLES

    found = {name: sql for name, sql in ORACLES.items() if name in _own_queries()}
    if llm := _llm():
        found |= llm[0].ORACLES | ({"pipeline": llm[1].ORACLE_SQL} if llm[1].ORACLE_SQL else {})
    return found
