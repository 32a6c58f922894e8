"""Line dedup by site-relative frequency.

Pages are grouped by the host of their URL.  For each line of a host, the share of the host's pages that contain it is
taken, and lines above ``percent`` of 100 are boilerplate of that host: they are dropped from all its pages.  A line of a
single page is never dropped (on a host of one page every line is on all pages); a caller may also leave hosts with fewer than ``least_pages`` pages alone.

Lines are cut after line breaks and before the tags of block elements, as they are shown on a page, and what stays is put
together again byte by byte.  A line is compared without the white space around it; empty ones are neither counted nor dropped.  A page's lines are
made distinct inside its row, so a page counts once; counts are summed before they are shuffled by host and line, so neither a
host nor a line that holds a third of all rows meets in one task.  A host has at most (lines a page) * 100 / percent
boilerplate lines; its list is joined to its pages, broadcast while the lists are counted to be few, else by a shuffle.

Defined cases: a null URL and one without ``://`` have the empty host, which is a host like others; a null or empty html has no
lines; repeated rows and null ids are pages like others; a share equal to the ratio is kept; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import handed_over
from .url_filter import parts

PERCENT = 50
LEAST_PAGES = 1
MOST_BROADCAST = 1_000_000
_WHITE = " \t\n\x0b\x0c\r"
#: Block elements of HTML.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
_CUT = rf"(?<=\n)|(?i)(?=<(?:{BLOCKS})[ >/])"


def _lines(html: Column) -> Column:
    return F.filter(F.split(F.coalesce(html, F.lit("")), _CUT), lambda line: line != "")


def _key(line: Column) -> Column:
    """What lines are compared by, a digest of the trimmed text; null for an empty line."""
    body = F.btrim(line, F.lit(_WHITE))
    return F.when(body != "", F.md5(body))


def boilerplate(pages: DataFrame, percent: int = PERCENT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, keys: the lines that more than ``percent`` of 100 of a host's pages contain."""
    rows = pages.select(parts(F.col("url"))[0].alias("host"), _lines(F.col("html")).alias("lines"))
    # The page itself is counted as the empty key, so totals come from the same aggregate.
    keys = F.array_union(F.array_distinct(F.filter(F.transform("lines", _key), lambda k: k.isNotNull())), F.array(F.lit("")))
    counts = handed_over(rows.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line_counts")
    totals = counts.where(F.col("key") == "").where(F.col("n") >= least_pages).select("host", F.col("n").alias("total"))
    if totals.count() <= MOST_BROADCAST:
        totals = F.broadcast(totals)
    often = counts.where(F.col("key") != "").join(totals, "host").where(F.col("n") * 100 > F.col("total") * percent)
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def without_boilerplate(pages: DataFrame, percent: int = PERCENT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, n_lines, n_dropped, kept (the text of the lines that stay)."""
    lists = handed_over(boilerplate(pages, percent, least_pages), "boilerplate").select(F.col("host").alias("_host"), "keys")
    if (lists.agg(F.sum(F.size("keys"))).first()[0] or 0) <= MOST_BROADCAST:
        lists = F.broadcast(lists)
    rows = pages.select("page_id", parts(F.col("url"))[0].alias("host"), _lines(F.col("html")).alias("lines"))
    known = rows.join(lists, F.col("host") == F.col("_host"), "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    stays = known.withColumn("stays", F.filter("lines", lambda line: ~F.coalesce(F.array_contains(F.col("keys"), _key(line)), F.lit(False))))
    return stays.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"),
                        F.array_join("stays", "").alias("kept"))
