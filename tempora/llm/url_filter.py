"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for all other URLs.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows it up
to ``?``, ``#`` or the end.  A rule fits its host and all subdomains where the path starts with the rule's path; of several
the longest wins (of equally long ones the first in text order).  URLs that no rule fits are judged by a logistic
regression on the hashed n-grams of host and path.  It is trained from a small labelled URL table; :func:`labelled`
makes one from the URLs that the rules judge, at most ``max_labelled`` of them (those with the least hashes).

Everything is DataFrame functions and Spark's own feature hasher and logistic regression; the model is one weight a
hash bucket, of a size that doesn't depend on the data.

Defined cases: a null URL and one without ``://`` have an empty host and path, which no rule fits and the model judges by
its intercept; with labels of one kind only, that is every verdict; without labels the verdict is allow; repeated
rows and null ids are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import handed_over

NGRAMS = (3, 4)
HASH_BUCKETS = 1 << 16
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Rule:
    """``host`` and the start of ``path``, which begins with ``/``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    marker = F.instr(url, "://")
    rest = F.when(marker > 0, F.substring(url, marker + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule (its text or null) and by_rule (its verdict or null)."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = {r: ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
            for r in sorted(rules, key=lambda r: (-len(r.text), r.text))}

    def first_fit(value):
        return F.coalesce(*(F.when(fit, F.lit(value(r))) for r, fit in fits.items()), F.lit(None).cast("string"))

    return urls.withColumns({"rule": first_fit(lambda r: r.text), "by_rule": first_fit(lambda r: r.verdict)})


def ngrams(name: str) -> Column:
    """The character n-grams of a column, each marked with the column's name."""
    chars = F.filter(F.split(F.concat(F.lit("^"), F.col(name), F.lit("$")), ""), lambda c: c != "")

    def of(n: int) -> Column:
        last = F.size(chars) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                             lambda i: F.concat(F.lit(f"{name}:"), F.array_join(F.slice(chars, i, n), "")))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in NGRAMS))


def with_features(urls: DataFrame) -> DataFrame:
    grams = urls.withColumn("grams", F.concat(ngrams("host"), ngrams("path")))
    return HashingTF(numFeatures=HASH_BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(grams).drop("grams")


def labelled(urls: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """host, path and label (1: block) of the URLs that rules judge, at most ``max_labelled`` distinct ones."""
    known = urls.where("by_rule IS NOT NULL").select("host", "path", (F.col("by_rule") == "block").cast("double").alias("label")).distinct()
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled)


def judged(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_score (the model's probability of block)."""
    urls = ruled(pages, rules)
    labels = handed_over(labelled(urls) if labels is None else labels.select("host", "path", "label"), "labelled_urls")
    kinds = sorted(row[0] for row in labels.select("label").distinct().limit(3).collect())
    if len(kinds) < 2:
        scored = urls.withColumn("block_score", F.lit(kinds[0] if kinds else 0.0))
    else:
        # One partition of at most max_labelled rows: the same sums, and so the same model, in every run.
        table = with_features(labels.repartitionByRange(1, "host", "path").sortWithinPartitions("host", "path"))
        model = LogisticRegression(maxIter=50, regParam=1e-3, standardization=False).fit(table)
        scored = model.transform(with_features(urls)).withColumn("block_score", F.element_at(vector_to_array(F.col("probability")), 2))
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
