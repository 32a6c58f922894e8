"""Corpora derived from the provided tables.

The library works on dated text (articles) and on dated phrase occurrences.
These adapters turn the provided Parquet tables into those shapes; every
derived frame grows with its source table.

* C1 ``articles_from_documents``: one article per ``documents`` row.  The
  table has no dates, so year and month are derived from the id
  (``year = 1900 + doc_id % 120``, ``month = 1 + (doc_id div 120) % 12``,
  day 15), ``section = source``, ``subsection = lang``.
* C2 ``phrases_from_orders``: ``lineitem ⋈ orders ⋈ part``; an order is an
  article, the cleaned part name is the phrase, the order date gives year and
  month, and the frequency is the number of line items of that order whose
  part carries the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import ids
from tempora.functions.text import clean_phrase
from tempora.functions.timeparts import decade_of_year

# Fixed derivation constants of corpus C1.
C1_FIRST_YEAR = 1900
C1_YEARS = 120
# What a task of a join or of a row-wise cleaning gets.
ROWS_PER_PARTITION = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(frame: DataFrame) -> int | None:
    """To how many partitions a table of fewer files than cores is to be dealt (``None``: it has enough of its own)."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return cores if len(frame.inputFiles()) < cores else None


def parts_of(rows: DataFrame) -> int:
    """So many partitions that one has at most some ``ROWS_PER_PARTITION`` rows, whatever the table's files are; all cores have one.
    The count comes from the Parquet footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_PARTITION))


def articles_from_documents(documents: DataFrame, source: str = "documents") -> DataFrame:
    """Articles of corpus C1: ``article_id, source_id, pub_date, year, month,
    decade, section, subsection, word_count, text``."""
    year = (F.lit(C1_FIRST_YEAR) + F.col("doc_id") % C1_YEARS).cast("int")
    month = (F.lit(1) + F.floor(F.col("doc_id") / C1_YEARS) % 12).cast("int")
    source_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    pub_date = F.format_string("%04d-%02d-15T00:00:00+0000", year, month)
    return documents.select(
        ids.article_id(source_id, source).alias("article_id"),
        source_id.alias("source_id"),
        pub_date.alias("pub_date"),
        year.alias("year"),
        month.alias("month"),
        decade_of_year(year).alias("decade"),
        F.col("source").alias("section"),
        F.col("lang").alias("subsection"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("bigint").alias("word_count"),
        F.col("doc_id"),
        F.col("text"),
    )


def archive_from_documents(documents: DataFrame) -> DataFrame:
    """Corpus C4: every document as an archive record (``doc``, ``file_path``), with fixed irregularities: missing, second
    and third ids, undated records, months only in the file name or nowhere, empty and missing headlines, sections,
    keywords and keyword values, and quotes and backslashes in them."""
    key = F.col("doc_id")
    year = F.lit(C1_FIRST_YEAR) + key % C1_YEARS
    month = F.lit(1) + F.floor(key / C1_YEARS) % 12
    null = F.lit(None).cast("string")
    keywords = (F.when(key % 3 == 1, F.array(F.struct(F.lit("subject").alias("name"), F.col("lang").alias("value"))))
                .when(key % 3 == 2, F.array(F.struct(F.lit("subject").alias("name"), null.alias("value")),
                                            F.struct(null.alias("name"), F.concat(F.lit('say "'), F.col("source"), F.lit('" \\')).alias("value")))))
    doc = F.struct(
        F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("doc-"), key.cast("string"))).alias("_id"),
        F.when(key % 22 == 0, F.concat(F.lit("uri-"), key.cast("string"))).alias("uri"),
        F.when(key % 33 == 0, F.concat(F.lit("https://example.org/"), key.cast("string"))).alias("web_url"),
        F.when(key % 17 == 0, "undated").when(key % 5 == 0, F.format_string("%04d-00-15", year))
        .otherwise(F.format_string("%04d-%02d-15T00:00:00+0000", year, month)).alias("pub_date"),
        F.struct(F.concat(F.lit("Item "), F.col("source")).alias("main"), F.when(key % 2 == 0, "").alias("print_headline")).alias("headline"),
        F.col("lang").alias("abstract"), null.alias("snippet"), F.col("text").alias("lead_paragraph"), keywords.alias("keywords"),
        F.when(key % 4 == 0, "").otherwise(F.col("source")).alias("section_name"), F.col("lang").alias("news_desk"),
        F.when(key % 2 == 1, F.col("lang")).alias("subsection_name"), key.alias("word_count"))
    path = F.when(key % 25 == 0, "/archive/misc.json").otherwise(F.format_string("/archive/%04d/%02d.json", year, month))
    return documents.select(doc.alias("doc"), path.alias("file_path"))


def input_lines_from_part(part: DataFrame) -> DataFrame:
    """JSON lines (``value``, ``_file``) of an input file with one row per part, and a blank line after each."""
    row = F.to_json(F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("phrase"),
                             F.when(F.col("p_size") % 2 == 0, "1990s").alias("expected_decade")))
    return part.select(F.explode(F.array(row, F.lit(" \t"))).alias("value"), F.lit("part").alias("_file"))


def phrases_from_orders(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Phrase occurrences of corpus C2 in the ``phrases`` table shape (without
    context): ``article_id, phrase_hash, phrase, year, month, decade, frequency``.

    Both joins are by partitions whose number grows with the line items, so a task's rows don't, and neither table is sent to every
    executor; the counts need no further exchange (nearly every order and name is a group of its own, so sums before it would only
    hold a task's whole split in memory)."""
    n = parts_of(lineitem)
    names = (part.select("p_partkey", "p_name").repartition(n, "p_partkey")
             .select("p_partkey", clean_phrase(F.col("p_name")).alias("phrase")).where(F.col("phrase").isNotNull()))
    dated = orders.select("o_orderkey",
                          F.year("o_orderdate").alias("year"),
                          F.month("o_orderdate").alias("month"))
    lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    named = lines.repartition(n, "p_partkey").join(names.hint("merge"), "p_partkey").select("o_orderkey", "phrase")
    counted = (named.repartition(n, "o_orderkey").join(dated.repartition(n, "o_orderkey").hint("merge"), "o_orderkey")
               .groupBy("o_orderkey", "phrase", "year", "month")
               .agg(F.count(F.lit(1)).cast("bigint").alias("frequency")))
    return counted.select(
        ids.article_id(F.col("o_orderkey").cast("string"), "orders").alias("article_id"),
        ids.phrase_hash(F.col("phrase")).alias("phrase_hash"),
        "phrase",
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        decade_of_year(F.col("year")).alias("decade"),
        "frequency")


def c2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases_from_orders(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
                               table(spark, sf_dir, "part"))


def c1_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------------
# C3: labelled predictions derived from orders
# ---------------------------------------------------------------------------
def predictions_from_orders(orders: DataFrame) -> DataFrame:
    """A predictions frame with the shape the metrics read, derived by fixed
    arithmetic from every order (so the metrics run over a table that grows
    with the data and has known edge cases):

    * ``expected_decade``: decade of (order year - 10 * (custkey % 5)); null for
      every 13th order key (unlabelled rows);
    * ``decades``: five neighbouring decades around (order year - 10 *
      (orderkey % 4)) with small integer scores from the keys (see below),
      normalized (ties happen) and rounded to 6 places; orders with status
      ``P`` and key divisible by 7 get an empty distribution (no prediction);
    * ``top_decade``/``confidence``: first maximum of the unrounded distribution;
    * ``input_size_group`` from the order priority (``5-LOW`` -> empty for even keys, else missing);
    * ``group``: ``directed`` when labelled, else ``random``.
    """
    from tempora.functions.distribution import round_array, top_of_array

    year = F.year("o_orderdate")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    expected = F.when(key % 13 != 0, decade_of_year(year - 10 * (cust % 5)))
    center = F.floor((year - 10 * (key % 4)) / 10) * 10
    scores = [(center - 20, 1 + (key + 2 * cust) % 2), (center - 10, 1 + cust % 3), (center, 1 + key % 3),
              (center + 10, 1 + (key + cust) % 2), (center + 20, 1 + (cust + 2 * key) % 3)]
    total = sum((s for _, s in scores[1:]), scores[0][1])
    dist = F.array(*[F.struct(F.concat(d.cast("bigint").cast("string"), F.lit("s")).alias("decade"),
                              (s.cast("double") / total).alias("probability")) for d, s in scores])
    empty = (F.col("o_orderstatus") == "P") & (key % 7 == 0)
    dist = F.when(empty, F.array().cast("array<struct<decade:string,probability:double>>")).otherwise(dist)
    size_group = (F.when(F.col("o_orderpriority") == "1-URGENT", "1_token")
                  .when(F.col("o_orderpriority") == "2-HIGH", "2_4_tokens")
                  .when(F.col("o_orderpriority") == "3-MEDIUM", "5_8_tokens")
                  .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "9_15_tokens")
                  .when(key % 2 == 0, ""))
    staged = orders.select(key.cast("string").alias("id"), expected.alias("expected_decade"),
                           dist.alias("_dist"), size_group.alias("input_size_group"))
    top = top_of_array(F.col("_dist"))
    return staged.select(
        "id", "expected_decade", "input_size_group",
        top["decade"].alias("top_decade"),
        F.round(top["probability"], 6).alias("confidence"),
        F.when(F.col("expected_decade").isNotNull(), top["decade"] == F.col("expected_decade")).alias(
            "matches_expected"),
        round_array(F.col("_dist"), 6).alias("decades"),
        F.when(F.col("expected_decade").isNotNull(), "directed").otherwise("random").alias("group"))


def c3_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from_orders(table(spark, sf_dir, "orders"))
