"""Timelines, statistics, features and the training set on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from tempora.functions import ids
from tempora.operators import features, timelines


@pytest.fixture()
def phrases(spark):
    rows = [("alpha", 1991, 2), ("alpha", 1992, 2), ("alpha", 2001, 1), ("beta", 1995, 3), ("gamma", 1995, 1),
            ("gamma", 1994, 1), ("beta", 1995, 1)]
    frame = spark.createDataFrame(rows, "phrase string, year int, frequency long")
    return frame.select(ids.phrase_hash(F.col("phrase")).alias("phrase_hash"), "phrase", "year",
                        F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s")).alias("decade"),
                        "frequency")


def test_timeline_normalizes_by_year_total(spark, phrases):
    rows = {(r["phrase"], r["year"]): r for r in timelines.phrase_timelines(phrases).collect()}
    assert rows[("beta", 1995)]["raw_count"] == 4
    assert rows[("beta", 1995)]["normalized_frequency"] == pytest.approx(4 / 5)
    assert rows[("alpha", 2001)]["normalized_frequency"] == pytest.approx(1.0)


def test_statistics_peaks_ties_and_entropy(spark, phrases):
    stats = {r["phrase"]: r for r in timelines.phrase_statistics(phrases).collect()}
    alpha = stats["alpha"]
    assert (alpha["first_year"], alpha["last_year"], alpha["total_count"]) == (1991, 2001, 5)
    assert alpha["peak_year"] == 1991            # tie 1991/1992 -> earliest
    assert alpha["peak_decade"] == "1990s"
    p = [4 / 5, 1 / 5]
    assert alpha["temporal_entropy"] == pytest.approx(-sum(x * math.log(x) for x in p) / math.log(2))
    assert stats["beta"]["temporal_entropy"] == 0.0  # one decade
    assert stats["gamma"]["peak_year"] == 1994


def test_window_rankings_agree_with_statistics(spark, phrases):
    tl = timelines.phrase_timelines(phrases)
    top_years = {r["phrase"]: r["year"] for r in timelines.ranked_years(tl).where("rank = 1").collect()}
    top_decades = {r["phrase"]: r["decade"] for r in timelines.ranked_decades(tl).where("rank = 1").collect()}
    stats = {r["phrase"]: r for r in timelines.phrase_statistics(phrases).collect()}
    assert all(stats[p]["peak_year"] == y for p, y in top_years.items())
    assert all(stats[p]["peak_decade"] == d for p, d in top_decades.items())


def test_features_and_training_set(spark, phrases):
    feats = features.build_features(timelines.phrase_timelines(phrases), min_count=2).collect()
    by = {(r["phrase"], r["decade"]): r for r in feats}
    assert ("gamma", "1990s") in by and ("beta", "1990s") in by
    alpha = [r for r in feats if r["phrase"] == "alpha"]
    assert sum(r["target_probability"] for r in alpha) == pytest.approx(1.0)
    score_90s = 2 / 2 + 2 / 2  # alpha's yearly shares in 1991 and 1992
    assert by[("alpha", "1990s")]["decade_score"] == pytest.approx(score_90s)
    assert features.build_features(timelines.phrase_timelines(phrases), min_count=5).select("phrase").distinct() \
        .count() == 1
    train = {r["phrase"]: r for r in features.training_set(
        features.build_features(timelines.phrase_timelines(phrases), min_count=1)).collect()}
    assert list(train["alpha"]["target"].keys()) == ["1990s", "2000s"]
    assert train["alpha"]["features"]["total_count"] == 5


def test_rows_without_hash_and_decade_give_the_same(spark, phrases):
    bare = phrases.drop("phrase_hash", "decade")

    def rows(frame):
        return sorted(tuple(round(v, 10) if isinstance(v, float) else v for v in r) for r in frame.collect())

    for of in (timelines.phrase_timelines, timelines.phrase_statistics, lambda p: features.build_features(timelines.phrase_timelines(p))):
        assert rows(timelines.with_phrase_hash(of(bare))) == rows(of(phrases))
    given = features.build_features(timelines.phrase_timelines(phrases), timelines.phrase_statistics(phrases))
    assert rows(given) == rows(features.build_features(timelines.phrase_timelines(phrases)))


def test_partitions_of_the_joins_grow_with_the_rows(spark, monkeypatch):
    from tempora.sources import corpora

    monkeypatch.setattr(corpora, "ROWS_PER_PARTITION", 3)
    assert corpora.parts_of(spark.range(3000)) == 1000


def test_c1_timelines_of_a_phrase_follow_each_other(spark, scratch):
    import glob

    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    docs = [(i, f"steam engine number {i % 13} runs past mill {i % 7}", "en", "web", 10) for i in range(240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    entry.c1_timelines(spark, scratch).write.parquet(f"{scratch}/out")
    files = [[(r["phrase"], r["year"]) for r in pq.read_table(f).select(["phrase", "year"]).to_pylist()] for f in sorted(glob.glob(f"{scratch}/out/*.parquet"))]
    assert all(rows == sorted(rows) for rows in files) and len({p for rows in files for p, _ in rows}) < sum(map(len, files)) / 10
    assert sum(len({p for p, _ in rows}) for rows in files) == len({p for rows in files for p, _ in rows})
