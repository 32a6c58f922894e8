"""Text cleaning as Spark column expressions.

Nearly everything here is built from JVM-side functions (regexes, array and
higher-order functions) so it stays inside Spark's code generation.  There are
two Python hops over Arrow batches.  Unicode NFKC, which Spark has no built-in for,
only receives texts that contain a character that NFKC could change (all other
texts are passed as null and cost nothing).  The contexts of a row's phrases
are looked up in one call a row (``contexts_of``).

Semantics (what the functions compute):

* ``normalize_text``: null/empty -> ""; NFKC; U+2019 -> "'"; a run of the same
  non-word, non-space character collapses to one; whitespace runs become one
  space; leading/trailing space removed.
* ``tokenize``: every match of ``[a-z][a-z0-9'-]*`` in the lower-cased
  normalized text (no word boundary, so "über" gives "ber").
* ``clean_phrase``: normalized lower text; characters other than
  ``[a-z0-9'-]`` and whitespace become spaces; whitespace collapsed; strip of
  space/hyphen/apostrophe at both ends; rejected (null) when shorter than 3 or
  longer than 90 characters, when letters are under 55 % of the characters,
  when any character repeats 5 times in a row, when there is no token or when
  all tokens are stopwords; else the tokens joined by one space.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# English stopwords used by phrase extraction and cleaning, in alphabetical order.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in",
    "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with",
)
# Token pattern (lower-case ASCII word with inner digits, apostrophes, hyphens).
TOKEN_PATTERN = "[a-z][a-z0-9'-]*"
# Phrase length bounds and minimum share of letters.
MIN_PHRASE_CHARS = 3
MAX_PHRASE_CHARS = 90
MIN_ALPHA_SHARE = 0.55
# Characters stripped from both ends of a cleaned phrase.
PHRASE_STRIP_CHARS = " -'"
# ---------------------------------------------------------------------------

# Whitespace as Python's Unicode-aware ``\s`` sees it, written for Java regex:
# Java's own ``\s`` is ASCII-only, so the information separators, NEL and the
# Unicode separator categories are added explicitly.
_WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WS_RUN = f"[{_WS}]+"
# A run (2+) of the same character that is neither a word character nor space.
PUNCT_RUN = rf"([^\p{{L}}\p{{N}}_{_WS}])\1+"


# ---------------------------------------------------------------------------
# NFKC: guard computed by rule from the running Python's Unicode tables
# ---------------------------------------------------------------------------
@functools.lru_cache(maxsize=1)
def _nfkc_stable_class() -> str:
    """Java character class of code points that are NFKC-stable in any context (beyond ASCII, of which all are).

    A code point is stable when NFKC maps it to itself, it is a starter
    (combining class 0) and it can never be the second half of a canonical
    composition.  Text made only of such code points is unchanged by NFKC, so
    it does not need the Python hop.  We only scan the first few blocks
    (Latin, Greek, Cyrillic, general punctuation) to keep the class short;
    anything else simply takes the Python path.  Java tests the ranges of a class
    from the last to the first, so the most frequent letters stand last.
    """
    limit = 0x0530
    seconds = set()
    for cp in range(0x110000 if sys.maxunicode > 0xFFFF else 0x10000):
        decomposition = unicodedata.decomposition(chr(cp))
        if decomposition and not decomposition.startswith("<"):
            parts = decomposition.split()
            if len(parts) == 2:
                seconds.add(int(parts[1], 16))
    seconds.update(range(0x1161, 0x1176))  # Hangul vowel jamo
    seconds.update(range(0x11A8, 0x11C3))  # Hangul trailing jamo

    def stable(cp: int) -> bool:
        ch = chr(cp)
        return (cp not in seconds and unicodedata.combining(ch) == 0
                and unicodedata.normalize("NFKC", ch) == ch)

    ranges: list[tuple[int, int]] = []
    for cp in list(range(0x80, limit)) + list(range(0x2010, 0x2028)):
        if stable(cp):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1] = (ranges[-1][0], cp)
            else:
                ranges.append((cp, cp))
    parts = []
    for lo, hi in reversed(ranges):
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


def nfkc_may_change(col: Column) -> Column:
    """True when ``col`` holds a character NFKC could change (JVM-side test).

    The class has some hundred ranges, and each costs a call: texts of ASCII alone aren't searched, and of others only characters
    beyond ASCII are looked up in it.
    """
    return (F.octet_length(col) != F.length(col)) & col.rlike(f"[\\x{{80}}-\\x{{10ffff}}&&[^{_nfkc_stable_class()}]]")


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(col: Column) -> Column:
    """Unicode NFKC of ``col``; the Python UDF only sees texts that may change."""
    return F.coalesce(_nfkc_udf(F.when(nfkc_may_change(col), col)), col)


# ---------------------------------------------------------------------------
# Normalization and tokens
# ---------------------------------------------------------------------------
def normalize_text(col: Column, unicode_nfkc: bool = True) -> Column:
    value = F.coalesce(col, F.lit(""))
    if unicode_nfkc:
        value = nfkc(value)
    value = F.regexp_replace(value, "’", "'")
    value = F.regexp_replace(value, PUNCT_RUN, "$1")
    value = F.regexp_replace(value, WS_RUN, " ")
    return F.trim(value)


def tokens_of_normalized(normalized: Column) -> Column:
    """Tokens of text that is already normalized."""
    return F.regexp_extract_all(F.lower(normalized), F.lit(TOKEN_PATTERN), 0)


def tokenize(col: Column) -> Column:
    return tokens_of_normalized(normalize_text(col))


def is_stopword(col: Column) -> Column:
    return col.isin(*STOPWORDS)


# ---------------------------------------------------------------------------
# Phrase cleaning (general form, any input text)
# ---------------------------------------------------------------------------
def _strip_phrase_ends(col: Column) -> Column:
    return F.btrim(col, F.lit(PHRASE_STRIP_CHARS))


def _phrase_checks(value: Column) -> Column:
    """Length / letter share / 5-run checks on a candidate cleaned value."""
    length = F.length(value)
    letters = length - F.length(F.translate(value, "abcdefghijklmnopqrstuvwxyz", ""))
    return ((length >= MIN_PHRASE_CHARS) & (length <= MAX_PHRASE_CHARS)
            & (F.try_divide(letters, length) >= MIN_ALPHA_SHARE)
            & ~value.rlike(r"(.)\1{4,}"))


def clean_phrase(col: Column) -> Column:
    """General ``clean_phrase``: null when the phrase is rejected."""
    value = F.lower(normalize_text(col))
    value = F.regexp_replace(value, f"[^a-z0-9'\\-{_WS}]", " ")
    value = _strip_phrase_ends(F.regexp_replace(value, WS_RUN, " "))
    tokens = F.regexp_extract_all(value, F.lit(TOKEN_PATTERN), 0)
    keep = (_phrase_checks(value) & (F.size(tokens) > 0)
            & F.exists(tokens, lambda t: ~is_stopword(t)))
    return F.when(keep, F.array_join(tokens, " "))


def clean_token_window(window: Column) -> Column:
    """``clean_phrase`` specialised to a space-joined window of tokens.

    A window is made of tokens that already match the token pattern, so
    cleaning can only collapse runs of hyphens/apostrophes and strip them from
    the end; the rejection rules are the same as ``clean_phrase``.  Tests check
    this against the general form.  The run-of-five check is done per token by
    the caller (runs cannot cross a space), so it is not repeated here.
    """
    value = F.when(window.contains("--") | window.contains("''"),
                   F.regexp_replace(window, r"([-'])\1+", "$1")).otherwise(window)
    value = F.when(value.endswith("-") | value.endswith("'"),
                   F.rtrim(value, F.lit(PHRASE_STRIP_CHARS))).otherwise(value)
    length = F.length(value)
    letters = length - F.length(F.translate(value, "abcdefghijklmnopqrstuvwxyz", ""))
    keep = ((length >= MIN_PHRASE_CHARS) & (length <= MAX_PHRASE_CHARS)
            & (F.try_divide(letters, length) >= MIN_ALPHA_SHARE) & ~is_stopword(value))
    return F.when(keep, value)


def clean_or_lower(col: Column) -> Column:
    """Cleaned phrase, falling back to lower+strip of the raw text."""
    return F.coalesce(clean_phrase(col), F.lower(strip_whitespace(col)))


# ---------------------------------------------------------------------------
# Context window around the first occurrence of a phrase
# ---------------------------------------------------------------------------
def context_window(normalized: Column, phrase: Column, radius: int = 40, lowered: Column | None = None,
                   text_length: Column | None = None, head: Column | None = None) -> Column:
    """Text around the first occurrence of ``phrase`` in ``normalized``.

    The search is on the lower-cased text (pass ``lowered`` when it is already
    computed); the slice is taken from the normalized text and trimmed.  When
    the phrase is not a substring (tokens were separated by punctuation), the
    first ``2 * radius`` characters.
    """
    lowered = F.lower(normalized) if lowered is None else lowered
    text_length = F.length(normalized) if text_length is None else text_length
    head = F.substring(normalized, 1, 2 * radius) if head is None else head
    pos = F.call_function("instr", lowered, phrase)  # 1-based, 0 when absent
    start = F.greatest(pos - radius, F.lit(1))
    end = F.least(pos - 1 + F.length(phrase) + radius, text_length)  # inclusive, 1-based
    around = F.substring(normalized, start, end - start + 1)
    return F.trim(F.when(pos > 0, around).otherwise(head))


#: Beyond so many characters times phrases, first occurrences come from one pass over the text for so many phrases at a time.
PASS_WORK = 20_000_000
PASS_PHRASES = 50_000


def first_places(lowered: str, phrases: list[str]) -> list[int]:
    """Where each phrase first stands in ``lowered`` (also inside a longer word); -1 where it doesn't.

    Few phrases of a short text are searched one by one.  Else they are looked up in an index of first occurrences that one pass over the text
    fills, so the work grows with the text and the phrases, not with their product.
    """
    if len(lowered) * len(phrases) <= PASS_WORK:
        return [lowered.find(p) for p in phrases]
    first: dict[str, int] = {}
    for at in range(0, len(phrases), PASS_PHRASES):
        wanted = ahocorasick.Automaton()
        for phrase in filter(None, phrases[at:at + PASS_PHRASES]):
            wanted.add_word(phrase, phrase)
        wanted.make_automaton()
        for end, phrase in wanted.iter(lowered):
            if phrase not in first:
                first[phrase] = end - len(phrase) + 1
    return [first.get(p, -1) for p in phrases]


def contexts_of(text: str, lowered: str, phrases: list[str], radius: int) -> list[str]:
    """The context of each phrase of one text, as by :func:`context_window`."""
    head = text[:2 * radius].strip(" ")
    return [text[max(0, p - radius):p + len(w) + radius].strip(" ") if p >= 0 else head for p, w in zip(first_places(lowered, phrases), phrases)]


def phrase_contexts(radius: int):
    """An Arrow function of (normalized text, the same in lower case, array of phrases): the context of each phrase, as by
    :func:`context_window`."""

    def contexts(texts: pa.Array, lowered: pa.Array, phrases: pa.Array) -> pa.Array:
        found = []
        for text, low, wanted in zip(texts, lowered, phrases):
            # A row without phrases has a null in their place.
            text, low, wanted = text.as_py(), low.as_py(), [w or "" for w in wanted.as_py()]
            found.append(contexts_of(text, low, wanted, radius))
        return pa.array(found, pa.list_(pa.string()))

    return F.arrow_udf(contexts, T.ArrayType(T.StringType()))


# ---------------------------------------------------------------------------
# Model features of a phrase
# ---------------------------------------------------------------------------
def strip_whitespace(col: Column) -> Column:
    """Remove leading/trailing whitespace (Unicode-aware, like Python's strip)."""
    return F.regexp_replace(col, f"^[{_WS}]+|[{_WS}]+$", "")


def cleaned_for_features(phrase: Column) -> Column:
    """Cleaned phrase, else the lower-cased, whitespace-stripped raw text."""
    return F.coalesce(clean_phrase(phrase), F.lower(strip_whitespace(phrase)))


def with_phrase_features(frame, phrase_col: str = "phrase", out_col: str = "phrase_features", ordered: bool = True):
    """Adds the distinct model features of ``phrase_col``, sorted unless ``ordered`` is false.

    Features are ``w:<token>`` for each token, ``b:<t1> <t2>`` for each
    adjacent token pair, and ``c3:``/``c4:``/``c5:`` character grams of the
    cleaned text padded with one space on each side, skipping grams made only
    of whitespace.  The cleaned text and its tokens are staged as columns
    first (they may need the NFKC UDF, which cannot run inside a lambda).
    """
    staged = (frame.withColumn("_fclean", cleaned_for_features(F.col(phrase_col)))
              .withColumn("_ftoks", tokenize(F.col("_fclean"))))
    return (staged.withColumn(out_col, features_of_cleaned(F.col("_fclean"), F.col("_ftoks"), ordered))
            .drop("_fclean", "_ftoks"))


def features_of_cleaned(cleaned: Column, toks: Column, ordered: bool = True) -> Column:
    n = F.size(toks)
    words = F.transform(toks, lambda t: F.concat(F.lit("w:"), t))
    pair_starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(pair_starts, lambda i: F.concat(F.lit("b:"), F.element_at(toks, i), F.lit(" "),
                                                        F.element_at(toks, i + 1)))
    compact = F.concat(F.lit(" "), cleaned, F.lit(" "))
    length = F.length(compact)
    # A gram can only be all whitespace when the text has 3+ whitespace in a row.
    has_blank_run = compact.rlike(f"[{_WS}]{{3}}")
    grams = [_char_grams(compact, length, has_blank_run, size) for size in (3, 4, 5)]
    found = F.array_distinct(F.concat(words, pairs, *grams))
    return F.sort_array(found) if ordered else found


def _char_grams(compact: Column, length: Column, has_blank_run: Column, size: int) -> Column:
    starts = F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(
        F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        return F.call_function("substring", compact, i, F.lit(size))

    kept = F.when(has_blank_run, F.filter(starts, lambda i: ~gram(i).rlike(f"^[{_WS}]+$"))).otherwise(starts)
    return F.transform(kept, lambda i: F.concat(F.lit(f"c{size}:"), gram(i)))
