"""Language ID by rank-order profiles.

A text is lower-cased, everything but letters becomes a blank, and the 1- to 3-grams of its words (with a blank before
and after each) are counted.  A language's profile is the list of its ``PROFILE`` most frequent n-grams over all
training texts.  A document's own most frequent n-grams are compared with each profile by out-of-place distance:
the difference of the ranks, or ``PROFILE`` for an n-gram that the profile lacks.  The least distance wins.

n-grams are 63-bit numbers (21 bits a code point), so counting is sorting numbers.  Training counts each batch's
n-grams before they are shuffled; only the profiles, of at most ``PROFILE`` numbers for each language, go to the driver.

Defined cases: a null text and one without a letter are ``und`` with score 0, as is everything without training
rows; of equal distances the language first in text order wins; equal counts are ordered by the n-gram; repeated
rows count as often as they stand; rows without a lang or with a null id don't train; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
PROFILE = 400
#: More languages than this are taken for a mistake (the profiles go through the driver).
MOST_LANGUAGES = 2000
_BLANK = 32
_CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point, or a blank for those that aren't letters."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, np.uint32(_BLANK)).astype(np.int64)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, in order, and their counts."""
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == _BLANK
    points = points[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(points) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = points == _BLANK
    pairs = points[:-1] << 21 | points[1:]
    triples = (pairs[:-1] << 21 | points[2:])[~blank[1:-1]]
    return np.unique(np.concatenate([points[~blank], pairs, triples]), return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram counts of each language in each batch."""
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            parts, chunk, chars = [], [], 0
            for text in [*own, None]:
                if text is None or chars + len(text) > _CHUNK:
                    parts.append(ngram_counts(" ".join(chunk)))
                    chunk, chars = [], 0
                chunk.append(text)
                chars += len(text or "")
            grams, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Profiles:
    """languages; grams, in order; ranks[gram, language], or -1."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def nearest(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngram_counts(text) if text and self.languages else (np.empty(0, np.int64),) * 2
        if not len(grams):
            return UNKNOWN, 0.0
        grams = grams[np.lexsort((grams, -counts))[:self.size]]
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == grams)[:, None], self.ranks[at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(grams))


def trained(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """The profiles of all rows (text, lang) of ``labelled`` that have both."""
    schema = "lang string, gram long, n long"
    counts = (labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, schema)
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = [F.desc("n"), "gram"]
    # The most frequent of each part of a language's n-grams, then of the language: no task sorts a whole language.
    some = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= size)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= size).select("lang", "gram", "rank")
    rows = top.limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted({row.lang for row in rows})
    grams = np.unique(np.asarray([row.gram for row in rows], dtype=np.int64))
    ranks = np.full((len(grams), len(languages)), -1, dtype=np.int64)
    if rows:
        ranks[np.searchsorted(grams, [row.gram for row in rows]), [languages.index(row.lang) for row in rows]] = [row["rank"] - 1 for row in rows]
    return Profiles(languages, grams, ranks, size)


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (1 - distance / greatest distance)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.nearest(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def recognised(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told (not ``und``); without a profile, those with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index("text")
        for batch in batches:
            yield batch.filter(pa.array([stays(text) for text in batch.column(at).to_pylist()], pa.bool_()))

    def stays(text: str | None) -> bool:
        return shared.value.nearest(text)[0] != UNKNOWN if shared.value.languages else bool(text) and len(ngram_counts(text)[0]) > 0

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no profile learns from, by a checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by profiles of the rows that aren't held out."""
    profiles = trained(docs.where(~held_out(F.col("doc_id"))))
    found = predicted(docs, profiles)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
