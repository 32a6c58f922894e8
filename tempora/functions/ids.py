"""Deterministic identifiers.

An id is the lower-hex SHA-256 of the JSON text of a small object with its
keys sorted, written with ``", "`` between members and ``": "`` after keys,
non-ASCII characters kept as they are and control characters escaped.  The
JSON text is assembled with ``concat`` so the hash runs JVM-side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the source name inside article ids.
ARCHIVE_SOURCE = "nyt"
# JSON short escapes for control characters, in code order.
_SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string_body(col: Column) -> Column:
    """The inside of a JSON string literal for ``col`` (quotes not included).

    Texts without quotes, backslashes or control characters pass unchanged;
    the per-character control escapes only run when a control character is
    present.  Stage the result as its own column when it feeds several
    hashes, so the branches stay lazy.
    """
    quoted = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = quoted
    for code in range(0x20):
        ch = chr(code)
        target = _SHORT_ESCAPES.get(ch, f"\\u{code:04x}")
        escaped = F.replace(escaped, F.lit(ch), F.lit(target))
    return (F.when(col.rlike(r"[\x00-\x1f]"), escaped)
            .when(col.rlike(r'["\\]'), quoted)
            .otherwise(col))


def json_value(value: Column | str | int | None, numeric: bool = False, plain: bool = False) -> Column:
    """JSON text of one value: quoted string, bare number or ``null``.

    ``plain=True`` promises the string needs no escaping (skips the check).
    """
    if value is None:
        return F.lit("null")
    if isinstance(value, (str, int)) and not isinstance(value, Column):
        if isinstance(value, int):
            return F.lit(str(value))
        col = F.lit(value)
    else:
        col = value
    if numeric:
        return F.coalesce(col.cast("string"), F.lit("null"))
    body = col if plain else json_string_body(col)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def stable_hash(fields: Mapping[str, Column | str | int | None], numeric: set[str] | None = None,
                plain: set[str] | None = None) -> Column:
    numeric = numeric or set()
    plain = plain or set()
    parts: list[Column] = [F.lit("{")]
    for index, key in enumerate(sorted(fields)):
        if index:
            parts.append(F.lit(", "))
        parts.append(F.lit(f'"{key}": '))
        parts.append(json_value(fields[key], numeric=key in numeric, plain=key in plain))
    parts.append(F.lit("}"))
    return F.sha2(F.concat(*parts), 256)


def phrase_hash(phrase: Column, cleaned: bool = True) -> Column:
    """Hash of ``{"phrase": <phrase>}``; cleaned phrases never need escaping."""
    return stable_hash({"phrase": phrase}, plain={"phrase"} if cleaned else None)


def article_id(source_id: Column, source: str = ARCHIVE_SOURCE) -> Column:
    """Article id from the archive's source name and the document's source id."""
    return stable_hash({"source": F.lit(source), "source_id": source_id}, plain={"source"})


def embedding_id(phrase_hash_col: Column, model_name: Column | str) -> Column:
    model = F.lit(model_name) if isinstance(model_name, str) else model_name
    return stable_hash({"model_name": model, "phrase_hash": phrase_hash_col}, plain={"phrase_hash"})
