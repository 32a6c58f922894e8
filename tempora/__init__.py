"""tempora — temporal phrase analytics as Spark DataFrame operators.

Layers:
  functions/  column expressions (text cleaning, ids, time parts, distributions)
  sources/    scans and sinks (archive JSON, JSONL inputs, Parquet datasets, corpora)
  operators/  DataFrame -> DataFrame operators (phrases, timelines, features, metrics...)
  models/     profile model and TF-IDF model as Spark jobs
  plans/      multi-stage jobs (full build, evaluation runs, run comparison)
  streaming/  incremental ingest of archive files with Structured Streaming
"""

__version__ = "0.1.0"
