"""Archive ingest rules, the full build chain, evaluation runs and the
streaming ingest on the JSON fixtures (two decades, empty docs, a missing id,
an unparsable date, month 00, a date that disagrees with its path, a year
outside the range, a non-numeric path, quotes/backslashes, a ligature and
U+2019)."""

import os

import pytest
from pyspark.sql import functions as F

from tempora.models import profile
from tempora.operators.ingest import ingest
from tempora.plans import evaluate
from tempora.plans.build import BuildConfig, load_model, run_build
from tempora.sources import archive

RAW = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "raw")


def test_file_selection(spark):
    def files(**asked):
        return sorted(r.file_path.split("/raw/")[1] for r in archive.scan_archive(spark, RAW, **asked).collect())

    assert files(start_year=1900, end_year=1960) == ["1900/01.json", "1900/02.json", "1955/07.json", "misc/extra.json"]
    assert files(months=[7]) == ["1955/07.json", "misc/extra.json"]
    assert files(years=[1955, 2020]) == ["1955/07.json", "2020/01.json", "misc/extra.json"]
    assert archive.read_archive(spark, RAW + "/nowhere").collect() == []
    with pytest.raises(ValueError):
        archive.scan_archive(spark, RAW, start_year=2000, end_year=1990)


def files_opened(frame):
    """The number of files that the scan of ``frame`` planned to read."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_files_out_of_range_are_not_opened(spark):
    every = files_opened(archive.scan_archive(spark, RAW))
    some = archive.scan_archive(spark, RAW, start_year=1955, end_year=1955)
    assert files_opened(some) == 2 < every


def test_written_archive_is_read_back(spark, scratch):
    records = archive.read_archive(spark, RAW)
    before = sorted(records.select(F.to_json("doc")).collect())
    archive.write_archive(records, scratch + "/copy")
    again = archive.read_archive(spark, scratch + "/copy")
    assert sorted(again.select(F.to_json("doc")).collect()) == before
    names = {r.file_path.split("/raw/")[1].removeprefix("misc/") for r in records.select("file_path").distinct().collect()}
    assert {r.file_path.split("/copy/")[1] for r in again.select("file_path").distinct().collect()} == names
    # Written again, a file is replaced.
    archive.write_archive(records.where("file_path LIKE '%1955%'"), scratch + "/copy")
    assert sorted(archive.read_archive(spark, scratch + "/copy").select(F.to_json("doc")).collect()) == before


def test_ingest_rules(spark):
    articles, phrases = ingest(spark, RAW, start_year=1900, end_year=2020)
    rows = {r["source_id"]: r for r in articles.collect()}
    assert set(rows) == {"archive://article/1900-wire-office", "archive://article/1900-horse-carriage",
                         "archive://article/misc-1", "archive://article/1955-jet", "archive://article/2019-stray",
                         "archive://article/2020-turbine"}
    carriage = rows["archive://article/1900-horse-carriage"]
    assert carriage["month"] == 1 and carriage["section"] == "Metro"        # month 00 -> file name; desk fallback
    stray = rows["archive://article/2019-stray"]
    assert (stray["year"], stray["month"], stray["decade"]) == (2019, 12, "2010s")  # own date, not the path
    got = {r["phrase"] for r in phrases.where(F.col("article_id") == carriage["article_id"]).collect()}
    assert "horse carriage parade" in got and "crowd's cheers" in got
    stray_phrases = {r["phrase"] for r in phrases.where(F.col("article_id") == stray["article_id"]).collect()}
    assert "final report" in stray_phrases                                  # ligature through NFKC
    assert phrases.where(F.col("phrase_id").isNull() | F.col("context").isNull()).count() == 0


def test_full_build_and_rerun(spark, scratch):
    config = BuildConfig(raw_dir=RAW, root=scratch, start_year=1900, end_year=2020, min_count=1)
    first = run_build(spark, config, log=lambda *_: None)
    assert set(first.values()) >= {"written"}
    assert os.path.isdir(os.path.join(scratch, "articles", "year=1900", "month=01"))
    assert os.path.isdir(os.path.join(scratch, "phrases", "year=2020", "month=01"))
    for name in ("phrase_timelines", "phrase_statistics", "features", "embeddings", "training_dataset", "model"):
        assert os.path.isdir(os.path.join(scratch, name)), name
    model = load_model(spark, scratch)
    inputs = spark.createDataFrame([("a", "gas lamps"), ("b", "tidal turbine")],
                                   "id string, phrase string")
    tops = {r["id"]: r["top_decade"] for r in
            profile.prediction_table(inputs, profile.score_phrases(model, inputs)).collect()}
    assert tops == {"a": "1900s", "b": "2020s"}
    again = run_build(spark, config, log=lambda *_: None)
    assert set(again.values()) == {"skipped"}


def test_stages_are_skipped_only_over_their_own_tables(spark, scratch, monkeypatch):
    quiet = {"log": lambda *_: None}
    one, other = (BuildConfig(raw_dir=RAW, root=scratch, start_year=1900, end_year=2020, min_count=n) for n in (1, 3))

    def rows():
        return spark.read.parquet(scratch + "/features").count()

    run_build(spark, one, **quiet)
    first = rows()
    run_build(spark, other, **quiet)
    assert rows() < first
    again = run_build(spark, one, **quiet)
    assert set(again.values()) != {"skipped"} and rows() == first          # A, B, A
    # A reset that dies half-way leaves nothing that counts as finished.
    import tempora.plans.build as build

    monkeypatch.setattr(build, "phrase_timelines", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_build(spark, one, reset=True, **quiet)
    monkeypatch.undo()
    results = run_build(spark, one, **quiet)
    assert results["ingest"] == "skipped" and results["aggregate"] != "skipped" and results["train"] == "written" and rows() == first
    # Another configuration that dies while it writes a table: the stages of the first one are not taken for finished.
    monkeypatch.setattr(build, "phrases_of_articles", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_build(spark, other, **quiet)
    monkeypatch.undo()
    assert run_build(spark, one, **quiet)["ingest"] == "written" and rows() == first
    # A table that lost rows since its stage was committed is made again.
    spark.read.parquet(scratch + "/features").limit(1).write.mode("overwrite").parquet(scratch + "/cut")
    spark.read.parquet(scratch + "/cut").write.mode("overwrite").parquet(scratch + "/features")
    mended = run_build(spark, one, **quiet)
    assert mended["aggregate"] == "skipped" and mended["features"] == "written" and rows() == first


def test_stages_do_not_hang_on_the_clock(spark, scratch, monkeypatch):
    """What another configuration began is newer, also by a clock that went back; a stage begun again is not finished."""
    import tempora.plans.build as build

    now = build._dt.datetime.now(build._dt.timezone.utc)
    build._mark(spark, scratch, "one", "ingest", build.STARTED)
    build._mark(spark, scratch, "one", "ingest", build.FINISHED)
    build._mark(spark, scratch, "one", "aggregate", build.FINISHED)
    assert build._finished(spark, scratch, "one") == {"ingest", "aggregate"} and build._finished(spark, scratch, "other") == set()
    build._mark(spark, scratch, "one", "aggregate", build.STARTED)
    assert build._finished(spark, scratch, "one") == {"ingest"}

    class Earlier(build._dt.datetime):
        @classmethod
        def now(cls, tz=None):
            return now - build._dt.timedelta(days=9)

    monkeypatch.setattr(build._dt, "datetime", Earlier)
    build._mark(spark, scratch, "other", "ingest", build.STARTED)
    assert build._finished(spark, scratch, "one") == set()


def test_model_loader(spark, scratch):
    fallback = evaluate.load_model(spark, "profile", scratch + "/none")
    assert fallback.features.count() == 0 and fallback.prior.count() == 18
    with pytest.raises(FileNotFoundError):
        evaluate.load_model(spark, "tfidf", scratch + "/none")
    with pytest.raises(ValueError):
        evaluate.load_model(spark, "other")
    profile.fit_profile(spark.createDataFrame([("gas lamp", {"1900s": 1.0})], "phrase string, target map<string,double>")).save(scratch + "/model")
    assert evaluate.load_model(spark, "profile", scratch + "/model").features.count() > 0


def test_evaluation_runs_and_comparison(spark, scratch):
    path = os.path.join(scratch, "inputs.jsonl")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('{"id": "E1", "phrase": "harbour pilot", "expected_decade": "1900s"}\n\n')
        handle.write('{"id": "E2", "phrase": "tidal turbine", "expected_decade": "2020s"}\n')
    training = spark.createDataFrame([("harbour pilot", {"1900s": 1.0}), ("tidal turbine", {"2020s": 1.0})],
                                     "phrase string, target map<string,double>")
    model = profile.fit_profile(training)
    out = os.path.join(scratch, "runs")
    evaluate.run_evaluation(spark, path, out, model, run_id="r1")
    evaluate.run_evaluation(spark, path, out, None, run_id="r2")
    headline, dist = evaluate.compare_runs(spark, out, ["r1", "r2"])
    got = {r["run_id"]: r["top1_accuracy"] for r in headline.collect()}
    assert got["r1"] == pytest.approx(1.0) and got["r2"] == 0.0  # uniform fallback picks 1850s
    assert evaluate.latest_run(spark, out).first()["run_id"] == "r2"
    assert set(dist.columns) == {"top_decade", "r1", "r2"}
    # An id again replaces that run alone, also by one without rows, and is the latest then.
    predictions = spark.read.parquet(out + "/prediction_rows/run_id=r1")
    evaluate.store_run(predictions.limit(0), out, "r1")
    headline, _ = evaluate.compare_runs(spark, out, ["r1", "r2"])
    assert {r["run_id"]: r["total"] for r in headline.collect()} == {"r1": 0, "r2": 2}
    assert evaluate.latest_run(spark, out).first()["run_id"] == "r1"
    with pytest.raises(ValueError):
        evaluate.compare_runs(spark, out, ["r1", "r9"])
    with pytest.raises(ValueError):
        evaluate.store_run(predictions, out, "../r1")


def test_evaluation_loads_the_model_it_names(spark, scratch):
    path = os.path.join(scratch, "inputs.jsonl")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('{"id": "E1", "phrase": "gas lamp", "expected_decade": "1900s"}\n')
    with pytest.raises(FileNotFoundError):
        evaluate.run_evaluation(spark, path, scratch + "/out", run_id="a", model_type="tfidf", model_path=scratch + "/none")
    with pytest.raises(ValueError):
        evaluate.run_evaluation(spark, path, scratch + "/out", profile.ProfileModel.fallback(spark), run_id="a", model_type="tfidf")
    profile.fit_profile(spark.createDataFrame([("gas lamp", {"1900s": 1.0})], "phrase string, target map<string,double>")).save(scratch + "/model")
    evaluate.run_evaluation(spark, path, scratch + "/out", run_id="b", model_path=scratch + "/model")
    assert evaluate.compare_runs(spark, scratch + "/out", ["b"])[0].first()["top1_accuracy"] == 1.0
    assert spark.read.parquet(scratch + "/out/runs").select("run_id", "number", "model_type").collect() == [("b", 1, "profile")]


def test_strict_inputs_fail_on_bad_rows(spark, scratch):
    from tempora.sources.jsonl import read_inputs

    path = os.path.join(scratch, "bad.jsonl")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('{"id": "E1", "phrase": "ok"}\n{"phrase": "no id"}\n')
    with pytest.raises(Exception, match="Invalid input row"):
        read_inputs(spark, path).collect()


def test_streaming_ingest_once(spark, scratch):
    from tempora.streaming.ingest_stream import start_ingest_stream

    query = start_ingest_stream(spark, RAW, scratch + "/stream", checkpoint=scratch + "/ckpt", once=True)
    query.awaitTermination(300)
    articles = spark.read.parquet(scratch + "/stream/stream_articles")
    assert articles.count() == 7   # every dated article with an id (no year range in the stream)
    assert spark.read.parquet(scratch + "/stream/stream_phrases").where(F.col("phrase") == "jet engine").count() == 1
