"""Headline benchmark: the corpus build chain on the documents corpus plus
model scoring and evaluation metrics.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line with per-query seconds.  Each
stage reads what the previous stage wrote (like the build chain), so a query's
time is that stage alone:

* extract    documents -> all cleaned 1-4-word phrases with counts, contexts and
             ids, written year/month-partitioned
* timelines  phrases -> yearly timelines and phrase statistics
* features   timelines + statistics -> per-decade features and training set
* train      profile model fit (one aggregate by feature) and save
* score      profile model scoring of part-derived inputs -> prediction table
* evaluate   all evaluation metrics over the orders-derived predictions

``extra`` holds what is not part of the total: bare extraction (no contexts, ids
or write) of the top 300 and of all phrases, which the survey's probe can be
compared with.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tempora.models import profile  # noqa: E402
from tempora.operators import features, timelines  # noqa: E402
from tempora.operators.phrases import extract_phrases, with_phrase_ids  # noqa: E402
from tempora.plans.evaluate import metric_tables  # noqa: E402
from tempora.session import local_session  # noqa: E402
from tempora.sources import corpora, datasets  # noqa: E402


def _noop(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    out = os.environ.get("BENCH_OUT") or tempfile.mkdtemp(prefix="tempora-bench-")
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="tempora-bench")

    # Warm-up outside the timings: JVM code paths and the Python worker.
    warm = corpora.c1_articles(spark, sf_dir).limit(20)
    _noop(extract_phrases(warm, "doc_id", "text", carry=["year", "month", "decade"]))

    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    def bare(max_phrases):
        articles = corpora.c1_articles(spark, sf_dir)
        _noop(extract_phrases(articles, "doc_id", "text", max_phrases=max_phrases, context_radius=None,
                              partitions=corpora.spread(articles)))

    def extract():
        articles = corpora.c1_articles(spark, sf_dir).withColumnRenamed("article_id", "aid")
        found = extract_phrases(articles, "aid", "text", carry=["year", "month", "decade"],
                                partitions=corpora.spread(articles))
        rows = with_phrase_ids(found.withColumnRenamed("aid", "article_id"))
        datasets.write_partitioned(rows, out, "phrases", sort_by="phrase_hash")

    def aggregate():
        phrases = datasets.read_dataset(spark, out, "phrases", required=True)
        datasets.replace_dataset(timelines.phrase_timelines(phrases), out, "phrase_timelines", sort_by="phrase_hash")
        tl = datasets.read_dataset(spark, out, "phrase_timelines", required=True)
        datasets.replace_dataset(timelines.phrase_statistics_from_timelines(tl), out, "phrase_statistics",
                                 sort_by="phrase_hash")

    def build_features():
        tl = datasets.read_dataset(spark, out, "phrase_timelines", required=True)
        stats = datasets.read_dataset(spark, out, "phrase_statistics", required=True)
        datasets.replace_dataset(features.build_features(tl, stats, min_count=2), out, "features",
                                 sort_by="phrase_hash")
        feats = datasets.read_dataset(spark, out, "features", required=True)
        datasets.replace_dataset(features.training_set(feats), out, "training_rows", sort_by="phrase")

    def train():
        rows = datasets.read_dataset(spark, out, "training_rows", required=True)
        profile.fit_profile(rows).save(f"{out}/model")

    def score():
        model = profile.ProfileModel.load(spark, f"{out}/model")
        part = corpora.table(spark, sf_dir, "part")
        inputs = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
                             F.concat_ws(" ", "p_name", F.lower("p_type")).alias("phrase"))
        _noop(profile.prediction_table(inputs, profile.score_phrases(model, inputs)))

    def evaluate():
        # As the evaluation job does: predictions are written once, every
        # metric table reads them back.
        corpora.c3_predictions(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/prediction_rows")
        predictions = spark.read.parquet(f"{out}/prediction_rows")
        for table in metric_tables(predictions).values():
            _noop(table)

    timed("extract", extract)
    timed("timelines", aggregate)
    timed("features", build_features)
    timed("train", train)
    timed("score", score)
    timed("evaluate", evaluate)

    extra: dict[str, float] = {}
    for name, most in (("bare_top_300", 300), ("bare_all", None)):
        start = time.perf_counter()
        bare(most)
        extra[name] = round(time.perf_counter() - start, 3)

    phrase_rows = datasets.read_dataset(spark, out, "phrases").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "build_chain_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
                      "phrase_rows": phrase_rows, "extra": extra}))
    spark.stop()


if __name__ == "__main__":
    main()
