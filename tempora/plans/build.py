"""Full build chain: archive -> articles/phrases -> timelines/statistics ->
features -> embedding manifest -> counts -> training set -> profile model.

Every stage reads its inputs from the tables the previous stages wrote
(``<root>/<dataset>``), so a stage boundary is also a lineage cut: a lost
executor only costs the tasks of the running stage.  Finished stages are
recorded in a small ``stage_runs`` table keyed by a run key (SHA-256 of the
build parameters); re-running with the same parameters skips them.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tempora.models.profile import ProfileModel, fit_profile
from tempora.operators.corpus import dataset_counts
from tempora.operators.embeddings import embedding_manifest
from tempora.operators.features import build_features, training_set
from tempora.operators.ingest import ARTICLE_COLUMNS, articles_with_text, phrases_of_articles
from tempora.operators.sampling import one_year_per_decade, SAMPLED_MONTHS
from tempora.operators.timelines import phrase_statistics_from_timelines, phrase_timelines
from tempora.session import shared_table
from tempora.sources import datasets
from tempora.sources.jsonl import write_training_jsonl

STAGES = ("ingest", "aggregate", "features", "embeddings", "validate", "training_set", "train")
#: Marks in the run table that all stages before it are to be done again.
RESET = "reset"
STARTED, FINISHED = "started", "finished"


@dataclass(frozen=True)
class BuildConfig:
    raw_dir: str
    root: str
    start_year: int = 1950
    end_year: int = 1999
    min_count: int = 2
    max_phrases: int | None = None
    context_radius: int = 40
    sample_one_year_per_decade: bool = False
    balance_decades: bool = False
    min_feature_weight: float = 0.0001
    extra: dict = field(default_factory=dict)

    def run_key(self) -> str:
        payload = json.dumps(asdict(self), sort_keys=True, default=str)
        return hashlib.sha256(payload.encode("utf-8")).hexdigest()


#: The tables whose rows are counted when a stage is committed.
STAGE_TABLES = {"ingest": ("articles", "phrases"), "aggregate": ("phrase_timelines", "phrase_statistics"), "features": ("features",),
                "embeddings": ("embeddings",), "training_set": ("training_rows",)}
_RUNS = "number long, run_key string, stage string, state string, result string, rows string, finished_at string"


def _written_rows(spark: SparkSession, root: str, stage: str) -> str:
    """Rows of the stage's tables, from the Parquet footers."""
    tables = {name: datasets.read_dataset(spark, root, name) for name in STAGE_TABLES.get(stage, ())}
    return json.dumps({name: None if t is None else t.count() for name, t in tables.items()}, sort_keys=True)


def _finished(spark: SparkSession, root: str, run_key: str) -> set[str]:
    """The stages whose tables are still those of ``run_key``.

    Rows are numbered, so no clock decides.  What another configuration or a reset began after a stage was finished counts against
    it, also when that one died before it was finished; so does a table that doesn't have the rows that were committed.
    """
    runs = datasets.read_dataset(spark, root, "stage_runs")
    if runs is None:
        return set()
    other = runs.where((F.col("run_key") != run_key) | (F.col("stage") == RESET)).agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    own = runs.where(F.col("number") > other.first()["last"])
    last = own.groupBy("stage").agg(F.max_by(F.struct("state", "rows"), "number").alias("at")).select("stage", "at.*")
    return {r.stage for r in last.collect() if r.state == FINISHED and r.rows == _written_rows(spark, root, r.stage)}


def _mark(spark: SparkSession, root: str, run_key: str, stage: str, state: str, result: str = "") -> None:
    runs = datasets.read_dataset(spark, root, "stage_runs")
    number = 1 + (0 if runs is None else runs.agg(F.max("number")).first()[0])
    rows = _written_rows(spark, root, stage) if state == FINISHED else ""
    frame = spark.createDataFrame([(number, run_key, stage, state, result, rows, _dt.datetime.now(_dt.timezone.utc).isoformat())], _RUNS)
    frame.coalesce(1).write.mode("append").parquet(datasets.dataset_path(root, "stage_runs"))


def run_build(spark: SparkSession, config: BuildConfig, reset: bool = False,
              log: Callable[[str], None] = print) -> dict[str, str]:
    if config.start_year > config.end_year:
        raise ValueError("start year must not be after end year")
    if config.start_year < 1850:
        log(f"warning: start year {config.start_year} is before 1850")
    key = config.run_key()
    root = config.root
    if reset:
        _mark(spark, root, key, RESET, STARTED)
    done = _finished(spark, root, key)
    results: dict[str, str] = {}

    def ingest() -> str:
        years = months = None
        if config.sample_one_year_per_decade:
            years = one_year_per_decade(config.start_year, config.end_year)
            months = list(SAMPLED_MONTHS)
        # The archive is parsed once: both tables are made from the articles with their text.
        articles = shared_table(articles_with_text(spark, config.raw_dir, config.start_year, config.end_year, years, months), "articles_with_text")
        datasets.write_partitioned(articles.select(*ARTICLE_COLUMNS), root, "articles")
        phrases = phrases_of_articles(articles, config.max_phrases, config.context_radius)
        datasets.write_partitioned(phrases, root, "phrases", sort_by="phrase_hash")
        return "written"

    def aggregate() -> str:
        phrases = datasets.read_dataset(spark, root, "phrases", required=True)
        datasets.replace_dataset(phrase_timelines(phrases), root, "phrase_timelines", sort_by="phrase_hash")
        timelines = datasets.read_dataset(spark, root, "phrase_timelines", required=True)
        datasets.replace_dataset(phrase_statistics_from_timelines(timelines), root, "phrase_statistics",
                                 sort_by="phrase_hash")
        return "written"

    def features() -> str:
        timelines = datasets.read_dataset(spark, root, "phrase_timelines", required=True)
        stats = datasets.read_dataset(spark, root, "phrase_statistics", required=True)
        datasets.replace_dataset(build_features(timelines, stats, config.min_count), root, "features",
                                 sort_by="phrase_hash")
        return "written"

    def embeddings() -> str:
        stats = datasets.read_dataset(spark, root, "phrase_statistics", required=True)
        datasets.replace_dataset(embedding_manifest(stats), root, "embeddings", sort_by="phrase_hash")
        return "written"

    def validate() -> str:
        names = ["articles", "phrases", "phrase_timelines", "phrase_statistics", "features", "embeddings"]
        counts = dataset_counts({n: datasets.read_dataset(spark, root, n) for n in names})
        return json.dumps({r["dataset"]: r["rows"] for r in counts.collect()}, sort_keys=True)

    def training() -> str:
        feats = datasets.read_dataset(spark, root, "features", required=True)
        # The table feeds the training; the JSON lines are an export for other tools.
        datasets.replace_dataset(training_set(feats), root, "training_rows", sort_by="phrase")
        rows = datasets.read_dataset(spark, root, "training_rows", required=True)
        write_training_jsonl(rows, datasets.dataset_path(root, "training_dataset"))
        return "written"

    def train() -> str:
        rows = datasets.read_dataset(spark, root, "training_rows", required=True)
        if rows.isEmpty():
            raise ValueError("the training set has no rows")
        model = fit_profile(rows, config.min_feature_weight, config.balance_decades)
        model.save(datasets.dataset_path(root, "model"))
        return "written"

    actions = {"ingest": ingest, "aggregate": aggregate, "features": features, "embeddings": embeddings,
               "validate": validate, "training_set": training, "train": train}
    for stage in STAGES:
        # A stage counts as finished only while all stages before it do.
        if stage in done and all(results[s] == "skipped" for s in results):
            log(f"stage {stage}: skipped (finished in an earlier run)")
            results[stage] = "skipped"
            continue
        log(f"stage {stage}: started")
        _mark(spark, root, key, stage, STARTED)
        results[stage] = actions[stage]()
        _mark(spark, root, key, stage, FINISHED, results[stage])
        log(f"stage {stage}: finished ({results[stage]})")
    return results


def load_model(spark: SparkSession, root: str) -> ProfileModel:
    return ProfileModel.load(spark, datasets.dataset_path(root, "model"))
