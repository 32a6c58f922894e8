"""Year, month and decade columns.

* year of a publication date: the leading 4 digits of the text without white space around it (every
  accepted date format starts with them; the written year is kept, no time
  zone shift), else null;
* month: characters 6-7 when they are two digits and not ``00``, else the
  month taken from the archive file name;
* decade label: ``(year div 10) * 10`` followed by ``s``; decade sort key: the
  integer made of all digits of the label, 0 when there are none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.text import strip_whitespace


def year_from_pub_date(pub_date: Column) -> Column:
    value = strip_whitespace(pub_date)
    return F.when(value.rlike("^[0-9]{4}"), F.substring(value, 1, 4).cast("int"))


def month_from_pub_date(pub_date: Column) -> Column:
    digits = F.substring(pub_date, 6, 2)
    month = F.when((F.length(pub_date) >= 7) & digits.rlike("^[0-9]{2}$"), digits.cast("int"))
    return F.when(month != 0, month)


def month_from_path(path: Column) -> Column:
    """Month from a ``.../<MM>.json`` file name; null when not numeric."""
    return F.regexp_extract(path, r"/([0-9]+)\.json$", 1).try_cast("int")


def decade_of_year(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("bigint").cast("string"), F.lit("s"))


def decade_key(decade: Column) -> Column:
    digits = F.regexp_replace(decade, "[^0-9]", "")
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0).cast("bigint"))
