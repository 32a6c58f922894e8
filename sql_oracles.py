"""DuckDB SQL that recomputes each registered query independently.

These statements are the correctness gate: they restate the semantics in
plain SQL over the same Parquet tables (views ``documents``, ``part``,
``orders``, ``lineitem`` ...), in forms of their own (ordered lists, correlated
counts, algebraic entropy) where the Spark plans pack values and sum.  Doubles
are rounded to 10 places on both sides.
"""

from __future__ import annotations

# The stopwords.
STOPWORDS = """
a an and are as at be by for from in is it of on or that the to was were with
""".split()
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
WS = r"\s\x0b\x1c-\x1f\x{85}\pZ"
TOKEN = "[a-z][a-z0-9''-]*"
# Any of the characters a cleaned value can hold, five times in a row.
FIVE_RUN = "|".join(f"{c}{{5}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789 ") + "|-{5}|''{5}"


def decade(expr: str) -> str:
    return f"(CAST(({expr}) // 10 * 10 AS VARCHAR) || 's')"


def decade_key(expr: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_replace({expr}, '[^0-9]', '', 'g'), '') AS BIGINT), 0)"


def chars(expr: str) -> str:
    """Characters of a text (after the U+2019 replacement), as a list."""
    return f"regexp_extract_all(replace(coalesce({expr}, ''), '’', ''''), '(?s).')"


def normalize_chars(col: str) -> str:
    """normalize_text (without NFKC: the provided texts are NFKC-stable) of a
    list-of-characters *column*: runs of the same non-word, non-space character
    collapse, whitespace runs become one space, ends trimmed."""
    return (f"trim(regexp_replace(array_to_string(list_filter({col}, lambda x, i: i = 1 "
            f"OR x <> {col}[i - 1] OR regexp_matches(x, '[\\pL\\pN_{WS}]')), ''), '[{WS}]+', ' ', 'g'))")


def clean_ctes(name: str, source: str, keys: str, expr: str, token_window: bool = False,
               out: str = "phrase") -> str:
    """Two CTEs: ``{name}_v`` (candidate value) and ``{name}`` (keys, cleaned value as ``out``)."""
    if token_window:
        lowered = f"regexp_replace(regexp_replace({expr}, '-{{2,}}', '-', 'g'), '''{{2,}}', '''', 'g')"
    else:
        source = f"(SELECT {keys}, {chars(expr)} AS _chars FROM {source})"
        lowered = f"lower({normalize_chars('_chars')})"
    value = (f"trim(regexp_replace(regexp_replace({lowered}, '[^a-z0-9''\\-{WS}]', ' ', 'g'), "
             f"'[{WS}]+', ' ', 'g'), ' -''')")
    return f"""
{name}_v AS (
  SELECT {keys}, v, regexp_extract_all(v, '{TOKEN}') AS tok
  FROM (SELECT {keys}, {value} AS v FROM {source})
),
{name} AS (
  SELECT {keys},
         CASE WHEN length(v) < 3 OR length(v) > 90 THEN NULL
              WHEN length(regexp_replace(v, '[^a-z]', '', 'g')) / length(v) < 0.55 THEN NULL
              WHEN regexp_matches(v, '{FIVE_RUN}') THEN NULL
              WHEN len(tok) = 0 THEN NULL
              WHEN len(list_filter(tok, lambda x: NOT list_contains({STOP}, x))) = 0 THEN NULL
              ELSE array_to_string(tok, ' ') END AS {out}
  FROM {name}_v
)"""


def context(norm: str, phrase: str, radius: int = 40) -> str:
    pos = f"strpos(lower({norm}), {phrase})"
    start = f"greatest({pos} - {radius}, 1)"
    end = f"least({pos} - 1 + length({phrase}) + {radius}, length({norm}))"
    return (f"trim(CASE WHEN {pos} > 0 THEN substring({norm}, {start}, {end} - {start} + 1) "
            f"ELSE substring({norm}, 1, {2 * radius}) END)")


def phrase_hash(expr: str) -> str:
    return f"sha256('{{\"phrase\": \"' || {expr} || '\"}}')"


# ---------------------------------------------------------------------------
# Corpus C1: documents
# ---------------------------------------------------------------------------
#: Every document, and every second one again under the id of another one.
C1_TWICE = ("SELECT * FROM documents UNION ALL "
            "SELECT doc_id // 2, text, lang, source, n_chars FROM documents WHERE doc_id % 2 = 1")

C1_DOCS = f"""
c1_docs AS (
  SELECT doc_id, row_number() OVER () AS copy,
         CAST(1900 + doc_id % 120 AS INTEGER) AS year,
         CAST(1 + (doc_id // 120) % 12 AS INTEGER) AS month,
         source, lang, text
  FROM documents
),
c1_chars AS (
  SELECT doc_id, copy, year, month, {chars('text')} AS c FROM c1_docs
),
c1_norm AS (
  SELECT doc_id, copy, year, month, {normalize_chars('c')} AS normalized FROM c1_chars
)"""

C1_PHRASES = C1_DOCS + f""",
c1_toks AS (
  SELECT doc_id, copy, year, month, regexp_extract_all(lower(normalized), '{TOKEN}') AS t FROM c1_norm
),
c1_win AS (
  SELECT doc_id, copy, year, month, k, unnest(generate_series(1, len(t) - k + 1)) AS i, t
  FROM c1_toks, (VALUES (1), (2), (3), (4)) AS v(k)
  WHERE len(t) >= k
),
c1_raw AS (
  SELECT doc_id, copy, year, month, array_to_string(t[i:i + k - 1], ' ') AS w
  FROM c1_win
  WHERE NOT list_contains({STOP}, t[i]) AND NOT list_contains({STOP}, t[i + k - 1])
),""" + clean_ctes("c1_clean", "c1_raw", "doc_id, copy, year, month", "w", token_window=True) + f""",
c1_counts AS (
  SELECT doc_id, copy, year, month, phrase, CAST(count(*) AS BIGINT) AS frequency
  FROM c1_clean WHERE phrase IS NOT NULL GROUP BY doc_id, copy, year, month, phrase
),
c1_phrases AS (
  SELECT p.doc_id, p.year, p.month, {decade('p.year')} AS decade, p.phrase, p.frequency,
         {context('n.normalized', 'p.phrase')} AS context, {phrase_hash('p.phrase')} AS phrase_hash
  FROM c1_counts p JOIN c1_norm n USING (doc_id, copy)
)"""

C1_ARTICLES = C1_DOCS + f""",
c1_articles AS (
  SELECT sha256('{{"source": "documents", "source_id": "doc-' || CAST(doc_id AS VARCHAR) || '"}}') AS article_id,
         'doc-' || CAST(doc_id AS VARCHAR) AS source_id,
         printf('%04d-%02d-15T00:00:00+0000', year, month) AS pub_date,
         year, month, {decade('year')} AS decade, source AS section, lang AS subsection,
         CAST(len(string_split_regex(trim(text), '\\s+')) AS BIGINT) AS word_count
  FROM c1_docs
)"""

# ---------------------------------------------------------------------------
# Corpus C2: lineitem ⋈ orders ⋈ part
# ---------------------------------------------------------------------------
C2_PHRASES = "WITH " + clean_ctes("c2_names", "part", "p_partkey", "p_name").lstrip() + f""",
c2_lines AS (
  SELECT o.o_orderkey, n.phrase,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(month(o.o_orderdate) AS INTEGER) AS month
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN c2_names n ON l.l_partkey = n.p_partkey
  WHERE n.phrase IS NOT NULL
),
c2_phrases AS (
  SELECT sha256('{{"source": "orders", "source_id": "' || CAST(o_orderkey AS VARCHAR) || '"}}') AS article_id,
         {phrase_hash('phrase')} AS phrase_hash, phrase, year, month, {decade('year')} AS decade,
         CAST(count(*) AS BIGINT) AS frequency
  FROM c2_lines GROUP BY o_orderkey, phrase, year, month
)"""


def chain(p: str, min_count: int) -> str:
    """CTEs from ``{p}_phrases`` (phrase_hash, phrase, year, decade, frequency) to timelines, decades, statistics and
    features."""
    return f""",
{p}_years AS (
  SELECT year, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM {p}_phrases GROUP BY year
),
{p}_timelines AS (
  SELECT phrase_hash, phrase, year, decade, CAST(sum(frequency) AS BIGINT) AS raw_count,
         sum(frequency) / CAST(any_value(total_frequency) AS DOUBLE) AS normalized_frequency
  FROM {p}_phrases JOIN {p}_years USING (year) GROUP BY phrase_hash, phrase, year, decade
),
{p}_decades AS (
  SELECT phrase_hash, phrase, decade, CAST(sum(raw_count) AS BIGINT) AS n, sum(normalized_frequency) AS score
  FROM {p}_timelines GROUP BY ALL
),
{p}_peaks AS (
  SELECT phrase_hash, min(year) AS first_year, max(year) AS last_year,
         (list(year ORDER BY raw_count DESC, year))[1] AS peak_year
  FROM {p}_timelines GROUP BY phrase_hash
),
{p}_stats AS (
  SELECT d.phrase_hash, d.phrase, CAST(any_value(first_year) AS INTEGER) AS first_year, CAST(any_value(last_year) AS INTEGER) AS last_year,
         CAST(any_value(peak_year) AS INTEGER) AS peak_year,
         (list(decade ORDER BY n DESC, decade))[1] AS peak_decade, CAST(sum(n) AS BIGINT) AS total_count,
         CASE count(*) WHEN 1 THEN 0.0 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) END AS temporal_entropy
  FROM {p}_decades d JOIN {p}_peaks USING (phrase_hash) GROUP BY d.phrase_hash, d.phrase
),
{p}_features AS (
  SELECT s.*, decade, score AS decade_score, n AS decade_raw_count,
         coalesce(score / nullif(sum(score) OVER (PARTITION BY s.phrase_hash), 0), 0.0) AS target_probability
  FROM {p}_stats s JOIN {p}_decades USING (phrase_hash, phrase) WHERE total_count >= {min_count}
)"""


C2_PHRASES += chain("c2", 2)
C1_CHAIN = chain("c1", 2)


def r10(expr: str, alias: str) -> str:
    return f"round({expr}, 10) AS {alias}"


ORACLES: dict[str, str] = {}

ORACLES["c1_normalized"] = "WITH " + C1_DOCS.lstrip() + f"""
SELECT doc_id, CAST(length(normalized) AS INTEGER) AS n_chars,
       CAST(len(regexp_extract_all(lower(normalized), '{TOKEN}')) AS INTEGER) AS n_tokens,
       sha256(normalized) AS normalized_hash
FROM c1_norm"""

ORACLES["c1_articles"] = "WITH " + C1_ARTICLES.lstrip() + """
SELECT article_id, source_id, pub_date, year, month, decade, section, subsection, word_count FROM c1_articles"""

ORACLES["c1_phrases"] = "WITH " + C1_PHRASES.lstrip() + """
SELECT doc_id, year, month, decade, phrase, frequency, context, phrase_hash FROM c1_phrases"""

ORACLES["c1_top_phrases"] = "WITH " + C1_PHRASES.lstrip() + """
SELECT doc_id, year, month, decade, phrase, frequency, context, phrase_hash FROM c1_phrases
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, phrase) <= 300"""

# The same document twice and, under one id, another document's text: every row stands for itself.
ORACLES["c1_phrases_repeated"] = "WITH " + C1_PHRASES.lstrip().replace("FROM documents\n", f"FROM ({C1_TWICE}) AS twice\n") + """
SELECT doc_id, year, month, decade, phrase, frequency, context, phrase_hash FROM c1_phrases"""

ORACLES["c1_phrases_sliced"] = "WITH " + C1_PHRASES.lstrip().replace("FROM documents\n", f"FROM ({C1_TWICE}) AS twice\n") + """
SELECT doc_id, year, month, decade, phrase, frequency, phrase_hash FROM c1_phrases"""

ORACLES["c1_inspect_targets"] = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + f"""
SELECT upper(phrase) AS asked, phrase AS cleaned_phrase, phrase_hash, decade, {r10('target_probability', 'target_probability')},
       decade_raw_count, {r10('decade_score', 'decade_score')},
       CAST(row_number() OVER (PARTITION BY phrase ORDER BY target_probability DESC, decade) AS INTEGER) AS target_rank,
       row_number() OVER (PARTITION BY phrase ORDER BY target_probability DESC, decade) <= 5 AS is_top
FROM c1_features"""

ORACLES["c1_statistics"] = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + f"""
SELECT phrase_hash, phrase, first_year, last_year, peak_year, peak_decade, total_count,
       {r10('temporal_entropy', 'temporal_entropy')}
FROM c1_stats"""

ORACLES["c1_timelines"] = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + f"""
SELECT phrase_hash, phrase, year, decade, raw_count, {r10('normalized_frequency', 'normalized_frequency')}
FROM c1_timelines"""

ORACLES["c1_features"] = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + f"""
SELECT phrase_hash, phrase, first_year, last_year, peak_year, peak_decade, total_count,
       {r10('temporal_entropy', 'temporal_entropy')}, decade, {r10('decade_score', 'decade_score')},
       decade_raw_count, {r10('target_probability', 'target_probability')}
FROM c1_features"""

ORACLES["c1_corpus_distribution"] = "WITH " + C1_PHRASES.lstrip() + """
SELECT 'articles_by_decade' AS section, decade, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT (CAST(year // 10 * 10 AS VARCHAR) || 's') AS decade FROM c1_docs) GROUP BY decade
UNION ALL
SELECT 'phrase_rows_by_decade', decade, CAST(count(*) AS DOUBLE) FROM c1_phrases GROUP BY decade
UNION ALL
SELECT 'phrase_frequency_by_decade', decade, CAST(coalesce(sum(frequency), 0) AS DOUBLE) FROM c1_phrases GROUP BY decade
UNION ALL
SELECT 'unique_phrases_by_decade', decade, CAST(count(DISTINCT phrase_hash) AS DOUBLE) FROM c1_phrases GROUP BY decade"""

ORACLES["c2_phrases"] = C2_PHRASES + """
SELECT article_id, phrase_hash, phrase, year, month, decade, frequency FROM c2_phrases"""

ORACLES["c2_yearly_totals"] = C2_PHRASES + """
SELECT year, total_frequency FROM c2_years"""

ORACLES["c2_timelines"] = C2_PHRASES + f"""
SELECT phrase_hash, phrase, year, decade, raw_count, {r10('normalized_frequency', 'normalized_frequency')}
FROM c2_timelines"""

ORACLES["c2_statistics"] = C2_PHRASES + f"""
SELECT phrase_hash, phrase, first_year, last_year, peak_year, peak_decade, total_count,
       {r10('temporal_entropy', 'temporal_entropy')}
FROM c2_stats"""

ORACLES["c2_ranked_years"] = C2_PHRASES + """
SELECT phrase_hash, phrase, CAST(year AS INTEGER) AS year, raw_count,
       CAST(1 + (SELECT count(*) FROM c2_timelines o WHERE o.phrase_hash = t.phrase_hash
                 AND (o.raw_count > t.raw_count OR o.raw_count = t.raw_count AND o.year < t.year)) AS INTEGER) AS rank
FROM c2_timelines t"""

ORACLES["c2_ranked_decades"] = C2_PHRASES + """
SELECT phrase_hash, phrase, decade, n AS decade_count,
       CAST(1 + (SELECT count(*) FROM c2_decades o WHERE o.phrase_hash = t.phrase_hash
                 AND (o.n > t.n OR o.n = t.n AND o.decade < t.decade)) AS INTEGER) AS rank
FROM c2_decades t"""

ORACLES["c2_features"] = C2_PHRASES + f"""
SELECT phrase_hash, phrase, first_year, last_year, peak_year, peak_decade, total_count,
       {r10('temporal_entropy', 'temporal_entropy')}, decade, {r10('decade_score', 'decade_score')},
       decade_raw_count, {r10('target_probability', 'target_probability')}
FROM c2_features"""


# ---------------------------------------------------------------------------
# Corpus C4: documents as archive records, parts as an input file
# ---------------------------------------------------------------------------
C4_ARTICLES = """c4_source AS (
  SELECT doc_id AS k, 1900 + doc_id % 120 AS y, 1 + (doc_id // 120) % 12 AS m, source, lang, text,
         CASE WHEN doc_id % 11 > 0 THEN 'doc-' || doc_id WHEN doc_id % 22 = 0 THEN 'uri-' || doc_id
              WHEN doc_id % 33 = 0 THEN 'https://example.org/' || doc_id END AS source_id
  FROM documents
),
c4_dated AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN printf('%04d-00-15', y) ELSE printf('%04d-%02d-15T00:00:00+0000', y, m) END AS pub_date,
         CASE k % 3 WHEN 1 THEN '[{"name": "subject", "value": ' || to_json(lang) || '}]'
              WHEN 2 THEN '[{"name": "subject", "value": null}, {"name": null, "value": ' || to_json('say "' || source || '" \\') || '}]'
              ELSE 'null' END AS keywords,
         CASE k % 3 WHEN 1 THEN ' ' || lang WHEN 2 THEN '  say "' || source || '" \\' ELSE '' END AS keyword_text
  FROM c4_source
  WHERE source_id IS NOT NULL AND k % 17 > 0 AND y BETWEEN 1905 AND 2010 AND NOT (k % 5 = 0 AND k % 25 = 0)
),
c4_docs AS (
  SELECT k AS doc_id, row_number() OVER () AS copy, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, source_id, pub_date, source, lang,
         sha256('{"source": "documents", "source_id": "' || source_id || '"}') AS article_id,
         sha256('{"abstract": ' || to_json(lang) || ', "headline": ' || to_json('Item ' || source) || ', "keywords": ' || keywords
                || ', "lead_paragraph": ' || coalesce(to_json(text), 'null') || ', "pub_date": ' || to_json(pub_date) || ', "snippet": null, "source_id": ' || to_json(source_id) || '}') AS content_hash,
         'Item ' || source || ' ' || lang || coalesce(' ' || text, '') || keyword_text AS text
  FROM c4_dated
)"""
C4_PHRASES = C4_ARTICLES + C1_PHRASES[C1_PHRASES.index(",\nc1_chars"):].replace("c1_", "c4_")

ORACLES["c4_articles"] = "WITH " + C4_ARTICLES + f""",
c4_chars AS (SELECT copy, {chars('text')} AS c FROM c4_docs)
SELECT article_id, source_id, content_hash, pub_date, year, month, {decade('year')} AS decade,
       CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS section, CASE WHEN doc_id % 2 = 1 THEN lang END AS subsection,
       doc_id AS word_count, sha256({normalize_chars('c')}) AS text
FROM c4_docs JOIN c4_chars USING (copy)"""

_C4_ROWS = ORACLES["c4_articles"].replace("\nSELECT article_id", ",\nc4_rows AS (SELECT article_id") + ")\n"

ORACLES["c4_archive"] = _C4_ROWS + "SELECT * FROM c4_rows WHERE month <= 6"

ORACLES["c4_rewritten"] = _C4_ROWS.rstrip() + """,
c4_again AS (SELECT * REPLACE ('again' AS section) FROM c4_rows WHERE month IN (3, 4) AND word_count % 2 = 0)
SELECT * FROM c4_again
UNION ALL
SELECT r.* FROM c4_rows r LEFT JOIN (SELECT DISTINCT year, month FROM c4_again) a USING (year, month) WHERE a.year IS NULL"""

ORACLES["c4_phrases"] = "WITH " + C4_PHRASES + """
SELECT sha256('{"article_id": "' || article_id || '", "context": ' || to_json(context) || ', "phrase": "' || phrase || '"}') AS phrase_id,
       article_id, phrase_hash, phrase, context, sha256('{"context": ' || to_json(context) || '}') AS context_hash, p.year, p.month, p.decade, frequency
FROM c4_phrases p JOIN (SELECT doc_id, article_id FROM c4_docs) USING (doc_id)"""

ORACLES["c4_inputs"] = """
SELECT 'P' || p_partkey AS id, p_name AS phrase, CASE WHEN p_size % 2 = 0 THEN '1990s' END AS expected_decade FROM part"""


# ---------------------------------------------------------------------------
# Corpus C3: labelled predictions derived from orders, and the metrics
# ---------------------------------------------------------------------------
_C3_OFFSETS = [(1, -20, "1 + (k + 2 * c) % 2"), (2, -10, "1 + c % 3"), (3, 0, "1 + k % 3"),
               (4, 10, "1 + (k + c) % 2"), (5, 20, "1 + (c + 2 * k) % 3")]
_C3_TOTAL = " + ".join(f"({s})" for _, _, s in _C3_OFFSETS)
_C3_LONG = "\n  UNION ALL\n".join(
    f"  SELECT id, {pos} AS pos, CAST(center + ({off}) AS VARCHAR) || 's' AS decade, ({s}) / ({_C3_TOTAL}) AS p "
    f"FROM c3_x WHERE NOT empty" for pos, off, s in _C3_OFFSETS)

C3 = f"""WITH c3_x AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, o_custkey AS c,
         CASE WHEN o_orderkey % 13 <> 0 THEN {decade('year(o_orderdate) - 10 * (o_custkey % 5)')} END
           AS expected_decade,
         (year(o_orderdate) - 10 * (o_orderkey % 4)) // 10 * 10 AS center,
         (o_orderstatus = 'P' AND o_orderkey % 7 = 0) AS empty,
         CASE o_orderpriority WHEN '1-URGENT' THEN '1_token' WHEN '2-HIGH' THEN '2_4_tokens'
              WHEN '3-MEDIUM' THEN '5_8_tokens' WHEN '4-NOT SPECIFIED' THEN '9_15_tokens'
              ELSE CASE WHEN o_orderkey % 2 = 0 THEN '' END END AS input_size_group
  FROM orders
),
c3_long AS (
{_C3_LONG}
),
c3_top AS (
  SELECT id, decade AS top_decade, round(p, 6) AS confidence
  FROM c3_long QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, pos) = 1
),
c3_rank AS (
  SELECT id, decade, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, pos) AS r FROM c3_long
),
c3_pred AS (
  SELECT x.id, x.expected_decade, x.input_size_group, t.top_decade, t.confidence,
         CASE WHEN x.expected_decade IS NOT NULL THEN coalesce(t.top_decade = x.expected_decade, false) END
           AS matches_expected,
         CASE WHEN x.expected_decade IS NOT NULL THEN 'directed' ELSE 'random' END AS "group"
  FROM c3_x x LEFT JOIN c3_top t USING (id)
),
c3_lab AS (
  SELECT p.id, p.expected_decade AS expected, coalesce(p.top_decade, 'None') AS predicted,
         coalesce(p.top_decade, 'None') = p.expected_decade AS top1,
         coalesce(r.r <= 3, false) AS topk,
         coalesce(p.confidence, 0.0) AS confidence,
         CASE WHEN p.input_size_group <> '' THEN p.input_size_group ELSE 'unknown' END AS size_group,
         CAST(abs({decade_key("coalesce(p.top_decade, 'None')")} - {decade_key('p.expected_decade')}) // 10 AS BIGINT)
           AS error
  FROM c3_pred p LEFT JOIN c3_rank r ON r.id = p.id AND r.decade = p.expected_decade
  WHERE p.expected_decade IS NOT NULL AND p.expected_decade <> ''
),
c3_confusion AS (
  SELECT expected AS expected_decade, predicted AS predicted_decade, CAST(count(*) AS BIGINT) AS count
  FROM c3_lab GROUP BY expected, predicted
),
c3_classes AS (
  SELECT expected_decade AS decade FROM c3_confusion UNION SELECT predicted_decade FROM c3_confusion
),
c3_report AS (
  SELECT cl.decade,
         CAST(coalesce((SELECT sum(count) FROM c3_confusion WHERE expected_decade = cl.decade), 0) AS BIGINT) AS support,
         CAST(coalesce((SELECT sum(count) FROM c3_confusion WHERE predicted_decade = cl.decade), 0) AS BIGINT)
           AS predicted,
         CAST(coalesce((SELECT sum(count) FROM c3_confusion
                        WHERE expected_decade = cl.decade AND predicted_decade = cl.decade), 0) AS BIGINT) AS tp,
         coalesce((SELECT string_agg(predicted_decade || ': ' || CAST(count AS VARCHAR), ', '
                                     ORDER BY count DESC, {decade_key('predicted_decade')})
                   FROM c3_confusion WHERE expected_decade = cl.decade AND predicted_decade <> cl.decade), '')
           AS confused_with
  FROM c3_classes cl
),
c3_report2 AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall
  FROM c3_report
),
c3_report3 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM c3_report2
)"""

ORACLES["c3_prediction_distribution"] = C3 + """
SELECT coalesce(top_decade, 'None') AS top_decade, CAST(count(*) AS BIGINT) AS count FROM c3_pred GROUP BY 1"""

ORACLES["c3_accuracy"] = C3 + f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE top1) AS BIGINT) AS top1_correct,
       CAST(count(*) FILTER (WHERE topk) AS BIGINT) AS top3_correct,
       {r10("CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE top1) / count(*) END", "top1_accuracy")},
       {r10("CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE topk) / count(*) END", "top3_accuracy")},
       {r10("CASE WHEN count(*) = 0 THEN 0.0 ELSE sum(error) / count(*) END", "mean_absolute_decade_error")},
       {r10("coalesce(avg(confidence) FILTER (WHERE top1), 0.0)", "confidence_correct_mean")},
       {r10("coalesce(avg(confidence) FILTER (WHERE NOT top1), 0.0)", "confidence_wrong_mean")}
FROM c3_lab"""

ORACLES["c3_rates_by_decade"] = C3 + f"""
SELECT expected AS expected_decade, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE top1) AS BIGINT) AS top1_correct,
       CAST(count(*) FILTER (WHERE topk) AS BIGINT) AS top3_correct,
       {r10("count(*) FILTER (WHERE top1) / count(*)", "top1_accuracy")},
       {r10("count(*) FILTER (WHERE topk) / count(*)", "top3_accuracy")}
FROM c3_lab GROUP BY expected"""

ORACLES["c3_rates_by_size"] = C3 + f"""
SELECT size_group AS input_size_group, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE top1) AS BIGINT) AS top1_correct,
       CAST(count(*) FILTER (WHERE topk) AS BIGINT) AS top3_correct,
       {r10("count(*) FILTER (WHERE top1) / count(*)", "top1_accuracy")},
       {r10("count(*) FILTER (WHERE topk) / count(*)", "top3_accuracy")},
       {r10("sum(confidence) / count(*)", "confidence_mean")}
FROM c3_lab GROUP BY size_group"""

ORACLES["c3_confusion"] = C3 + """
SELECT expected_decade, predicted_decade, count FROM c3_confusion"""

ORACLES["c3_confusion_matrix"] = C3 + """
SELECT e.decade AS expected, p.decade AS predicted, coalesce(c.count, 0) AS count
FROM c3_classes e CROSS JOIN c3_classes p
LEFT JOIN c3_confusion c ON c.expected_decade = e.decade AND c.predicted_decade = p.decade"""

ORACLES["c3_classification_report"] = C3 + f"""
SELECT decade, support, predicted, {r10('precision', 'precision')}, {r10('recall', 'recall')},
       {r10('f1', 'f1_score')}, tp AS true_positives, predicted - tp AS false_positives,
       support - tp AS false_negatives, tp AS correct, support - tp AS errors, confused_with
FROM c3_report3"""

ORACLES["c3_classification_summary"] = C3 + f"""
SELECT {r10('coalesce(avg(precision), 0.0)', 'macro_precision')},
       {r10('coalesce(avg(recall), 0.0)', 'macro_recall')},
       {r10('coalesce(avg(f1), 0.0)', 'macro_f1_score')},
       {r10('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(precision * support) / sum(support) END', 'weighted_precision')},
       {r10('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(recall * support) / sum(support) END', 'weighted_recall')},
       {r10('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END', 'weighted_f1_score')},
       {r10('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(tp) / sum(support) END', 'micro_precision')},
       {r10('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(tp) / sum(support) END', 'micro_recall')},
       {r10('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(tp) / sum(support) END', 'micro_f1_score')}
FROM c3_report3"""



def _headline(run: str, condition: str) -> str:
    """Accuracy and F1 of the rows that meet a condition, from sums over labels."""
    return f"""
SELECT '{run}' AS run_id, (SELECT count(*) FROM lab WHERE {condition}) AS total,
       (SELECT {r10('coalesce(avg(CAST(top1 AS INTEGER)), 0)', 'a')} FROM lab WHERE {condition}) AS top1_accuracy,
       (SELECT {r10('coalesce(avg(CAST(topk AS INTEGER)), 0)', 'a')} FROM lab WHERE {condition}) AS top3_accuracy,
       (SELECT {r10('coalesce(avg(error), 0)', 'a')} FROM lab WHERE {condition}) AS mean_absolute_decade_error,
       {r10('avg(f)', 'macro_f1_score')}, {r10('sum(f * support) / sum(support)', 'weighted_f1_score')}
FROM (SELECT sum(e) AS support, coalesce(2.0 * sum(hit) / nullif(sum(e) + sum(p), 0), 0) AS f
      FROM (SELECT expected AS label, 1 AS e, 0 AS p, CAST(top1 AS INTEGER) AS hit FROM lab WHERE {condition}
            UNION ALL SELECT predicted, 0, 1, 0 FROM lab WHERE {condition}) GROUP BY label)"""


ORACLES["c3_run_comparison"] = (C3 + ",\nlab AS (SELECT * FROM c3_lab)\nSELECT *, run_id = 'odd' AS latest FROM (" + _headline("all", "true") + "\nUNION ALL"
                                + _headline("odd", "CAST(id AS BIGINT) % 2 = 1") + ")")

ORACLES["c3_run_distribution"] = C3 + """
SELECT coalesce(top_decade, 'None') AS top_decade, CAST(count(*) AS BIGINT) AS all_rows,
       CAST(count(*) FILTER (WHERE CAST(id AS BIGINT) % 2 = 1) AS BIGINT) AS odd_rows FROM c3_pred GROUP BY 1"""

ORACLES["c3_sample_summary"] = C3 + """
SELECT CAST(count(*) AS BIGINT) AS total_inputs,
       CAST(count(*) FILTER (WHERE "group" = 'directed') AS BIGINT) AS directed_inputs,
       CAST(count(*) FILTER (WHERE "group" = 'random') AS BIGINT) AS random_inputs,
       CAST(count(*) FILTER (WHERE "group" = 'directed' AND coalesce(matches_expected, false)) AS BIGINT)
         AS directed_matches
FROM c3_pred"""

ORACLES["c3_inputs_by_size"] = C3 + """
SELECT CASE WHEN input_size_group <> '' THEN input_size_group ELSE 'unknown' END AS input_size_group, CAST(count(*) AS BIGINT) AS inputs
FROM c3_pred GROUP BY 1"""


# ---------------------------------------------------------------------------
# C2 derived reports, model features and the profile model
# ---------------------------------------------------------------------------
def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def features_ctes(name: str, source: str, keys: str, phrase: str) -> str:
    """CTEs ending in ``{name}(keys, feats)``: sorted distinct model features
    (``keys`` must include the phrase column)."""
    grams = " || ".join(
        f"list_transform(list_filter(generate_series(1, length(cp) - {k - 1}), "
        f"lambda i: NOT regexp_full_match(substring(cp, i, {k}), '[{WS}]+')), "
        f"lambda i: 'c{k}:' || substring(cp, i, {k}))" for k in (3, 4, 5))
    return clean_ctes(f"{name}_cl", source, keys, phrase, out="_clean") + f""",
{name}_c AS (
  SELECT {keys}, coalesce(_clean, lower({strip_ws(phrase)})) AS cleaned FROM {name}_cl
),
{name}_ch AS (
  SELECT {keys}, cleaned, {chars('cleaned')} AS _chars FROM {name}_c
),
{name}_t AS (
  SELECT {keys}, cleaned, ' ' || cleaned || ' ' AS cp,
         regexp_extract_all(lower({normalize_chars('_chars')}), '{TOKEN}') AS toks
  FROM {name}_ch
),
{name} AS (
  SELECT {keys}, list_sort(list_distinct(
           list_transform(toks, lambda t: 'w:' || t)
           || list_transform(generate_series(1, len(toks) - 1), lambda i: 'b:' || toks[i] || ' ' || toks[i + 1])
           || {grams})) AS feats
  FROM {name}_t
)"""


ORACLES["c1_profile_weights"] = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + """,
c1_tw AS (SELECT DISTINCT phrase, ln(1 + total_count) AS w FROM c1_features),""" + features_ctes("c1_tfeat", "c1_tw", "phrase, w", "phrase") + """
SELECT feature, round(sum(w), 4) AS weight, false AS uniform
FROM (SELECT w, unnest(feats) AS feature FROM c1_tfeat) GROUP BY feature HAVING sum(w) >= 5.0"""

ORACLES["c1_tfidf_grams"] = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + """,
c1_tp AS (SELECT DISTINCT phrase FROM c1_features),
c1_tw AS (SELECT phrase, ' ' || unnest(string_split(phrase, ' ')) || ' ' AS w FROM c1_tp),
c1_tg AS (
  SELECT phrase, substr(w, unnest(range(1, length(w) - k + 2)), k) AS gram
  FROM c1_tw, (VALUES (3), (4), (5)) AS sizes(k) WHERE length(w) >= k
)
SELECT gram, count(*) AS n, count(DISTINCT phrase) AS df,
       round(ln((1 + (SELECT count(*) FROM c1_tp)) / (1 + count(DISTINCT phrase))) + 1, 10) AS idf
FROM c1_tg GROUP BY gram"""


_C1_SAMPLE = "WITH " + C1_PHRASES.lstrip() + C1_CHAIN + """,
c1_lab AS (SELECT phrase, decade AS label FROM c1_features QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY target_probability DESC, decade) = 1),
c1_quota AS (SELECT label, count(*) AS n, ceil(5000.0 / count(*) OVER ()) AS quota FROM c1_lab GROUP BY label),
c1_chosen AS (
  SELECT phrase, label FROM c1_lab JOIN c1_quota USING (label)
  WHERE CAST('0x' || substr(md5(phrase), 1, 8) AS HUGEINT) * n < CAST(quota AS HUGEINT) * 4294967296
)"""

ORACLES["c1_tfidf_sample"] = _C1_SAMPLE + "SELECT phrase, label FROM c1_chosen"

ORACLES["c1_tfidf_properties"] = _C1_SAMPLE + """,
c1_sizes AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM c1_chosen) AS inputs,
                    (SELECT count(DISTINCT decade) FROM c1_features JOIN c1_chosen USING (phrase)) AS decades)
SELECT 'inputs' AS property, inputs AS value FROM c1_sizes
UNION ALL SELECT 'cells', inputs * decades FROM c1_sizes
UNION ALL SELECT unnest(['uneven', 'sums_off', 'outside', 'no_better_than_frequencies', 'half_of_training_rows_missed']), 0"""


C2_MODEL = C2_PHRASES + f""",
c2_tw AS (
  SELECT DISTINCT phrase, ln(1 + coalesce(nullif(total_count, 0), 1)) AS w,
         CAST(coalesce(nullif(total_count, 0), 1) AS DOUBLE) AS cnt
  FROM c2_features
),
c2_tentries AS (
  SELECT f.phrase, f.decade, f.target_probability AS p, t.w, t.cnt FROM c2_features f JOIN c2_tw t USING (phrase)
),
c2_bal_tot AS (SELECT decade, sum(p * cnt) AS total FROM c2_tentries GROUP BY decade),
c2_balance AS (
  SELECT decade, (SELECT avg(total) FROM c2_bal_tot) / total AS balance FROM c2_bal_tot WHERE total > 0
),
c2_prior_raw AS (
  SELECT e.decade, sum(e.p * e.w) AS s, sum(e.p * coalesce(b.balance, 1.0) * e.w) AS sb
  FROM c2_tentries e LEFT JOIN c2_balance b USING (decade) GROUP BY e.decade
),
c2_prior AS (
  SELECT decade, {decade_key('decade')} AS decade_key,
         CASE WHEN sum(greatest(s, 0)) OVER () > 0 THEN greatest(s, 0) / sum(greatest(s, 0)) OVER ()
              ELSE 1.0 / count(*) OVER () END AS prior,
         CASE WHEN sum(greatest(sb, 0)) OVER () > 0 THEN greatest(sb, 0) / sum(greatest(sb, 0)) OVER ()
              ELSE 1.0 / count(*) OVER () END AS prior_balanced
  FROM c2_prior_raw
),""" + features_ctes("c2_tfeat", "c2_tw", "phrase", "phrase") + f""",
c2_feat AS (SELECT phrase, unnest(feats) AS feature FROM c2_tfeat),
c2_fweights AS (
  SELECT f.feature, sum(t.w) AS weight FROM c2_feat f JOIN c2_tw t USING (phrase)
  GROUP BY f.feature HAVING sum(t.w) >= 0.0001
),
c2_fscores AS (
  SELECT f.feature, e.decade, sum(e.p * e.w) AS s FROM c2_feat f JOIN c2_tentries e USING (phrase)
  GROUP BY f.feature, e.decade
),
c2_fprofile AS (
  SELECT feature, decade, sum(greatest(s, 0)) OVER (PARTITION BY feature) AS tot,
         greatest(s, 0) / nullif(sum(greatest(s, 0)) OVER (PARTITION BY feature), 0) AS probability
  FROM c2_fscores
),
c2_mweights AS (
  SELECT w.feature, w.weight, bool_or(p.tot <= 0) AS uniform
  FROM c2_fweights w JOIN c2_fprofile p USING (feature) GROUP BY w.feature, w.weight
),
c2_mprofile AS (
  SELECT feature, decade, probability FROM c2_fprofile
  WHERE tot > 0 AND probability > 0 AND feature IN (SELECT feature FROM c2_fweights)
),
c2_inputs AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS id,
         CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat_ws(' ', p_name, lower(p_type))
              WHEN 2 THEN lower(p_type) ELSE upper(p_name) || '!!' END AS phrase,
         CASE p_size % 3 WHEN 0 THEN '1990s' WHEN 1 THEN '2000s' END AS expected_decade
  FROM part
),""" + features_ctes("c2_ifeat", "c2_inputs", "id, phrase", "phrase") + f""",
c2_imatch AS (
  SELECT f.id, f.feature, least(4.0, ln(1 + w.weight)) AS eff, w.uniform
  FROM (SELECT id, unnest(feats) AS feature FROM c2_ifeat) f JOIN c2_mweights w USING (feature)
),
c2_iw AS (
  SELECT id, sum(eff) AS infl, sum(CASE WHEN uniform THEN eff ELSE 0.0 END) AS uinfl FROM c2_imatch GROUP BY id
),
c2_is AS (
  SELECT m.id, p.decade, sum(m.eff * p.probability) AS s
  FROM c2_imatch m JOIN c2_mprofile p USING (feature) WHERE NOT m.uniform GROUP BY m.id, p.decade
),
c2_iscore AS (
  SELECT i.id, pr.decade, pr.decade_key,
         greatest((0.35 * pr.prior + coalesce(s.s, 0.0) + coalesce(w.uinfl, 0.0) / (SELECT count(*) FROM c2_prior))
                  / (0.35 + coalesce(w.infl, 0.0)), 0.0) AS raw
  FROM c2_inputs i CROSS JOIN c2_prior pr
  LEFT JOIN c2_iw w ON w.id = i.id
  LEFT JOIN c2_is s ON s.id = i.id AND s.decade = pr.decade
),
c2_idist AS (
  SELECT id, decade, decade_key,
         CASE WHEN sum(raw) OVER (PARTITION BY id) > 0 THEN raw / sum(raw) OVER (PARTITION BY id)
              ELSE 1.0 / count(*) OVER (PARTITION BY id) END AS probability
  FROM c2_iscore
)"""

C2_ARGMAX = """,
c2_argmax AS (
  SELECT phrase, decade FROM c2_features
  QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY target_probability DESC,
                             """ + decade_key("decade") + """, decade) = 1
),
c2_census AS (SELECT decade, CAST(count(*) AS BIGINT) AS n, min(phrase) AS first FROM c2_argmax GROUP BY decade)"""

C2_ASKED = ",\n" + """c2_asked_raw AS (
  SELECT DISTINCT asked FROM (SELECT p_name AS asked FROM part UNION ALL SELECT upper(p_name) || '!!' FROM part)
),""" + clean_ctes("c2_asked_cl", "c2_asked_raw", "asked", "asked") + f""",
c2_asked AS (
  SELECT asked, coalesce(phrase, lower({strip_ws('asked')})) AS cleaned_phrase,
         {phrase_hash(f"coalesce(phrase, lower({strip_ws('asked')}))")} AS phrase_hash
  FROM c2_asked_cl
)"""

ORACLES["c2_training_set"] = C2_PHRASES + f"""
SELECT phrase, phrase_hash, first_year, last_year, peak_year, peak_decade, total_count,
       {r10('temporal_entropy', 'temporal_entropy')},
       string_agg(decade, ',' ORDER BY {decade_key('decade')}, decade) AS target_decades,
       {r10('sum(target_probability)', 'target_sum')}
FROM c2_features
GROUP BY phrase, phrase_hash, first_year, last_year, peak_year, peak_decade, total_count, temporal_entropy"""

ORACLES["c2_training_exchange"] = C2_PHRASES + f"""
SELECT phrase, phrase_hash, first_year, last_year, peak_year, peak_decade, total_count,
       {r10('temporal_entropy', 'temporal_entropy')}, decade, {r10('target_probability', 'probability')}
FROM c2_features"""

ORACLES["c2_softmax"] = C2_PHRASES + f""",
c2_soft AS (
  SELECT phrase_hash, decade, decade_score, exp(decade_score - max(decade_score) OVER (PARTITION BY phrase_hash)) AS e
  FROM c2_features
)
SELECT phrase_hash, first_value(decade) OVER (PARTITION BY phrase_hash ORDER BY decade_score DESC, decade) AS top_decade, decade,
       {r10('e / sum(e) OVER (PARTITION BY phrase_hash)', 'probability')}
FROM c2_soft"""

ORACLES["c2_target_census"] = C2_PHRASES + C2_ARGMAX + """
SELECT decade, n AS rows, first AS first_phrase FROM c2_census"""

ORACLES["c2_target_census_summary"] = C2_PHRASES + C2_ARGMAX + f"""
SELECT CAST((SELECT count(DISTINCT phrase) FROM c2_features) AS BIGINT) AS rows,
       CAST(count(*) AS BIGINT) AS unique_decades,
       (SELECT decade FROM c2_census ORDER BY n DESC, first LIMIT 1) AS most_common_decade,
       CAST(max(n) AS BIGINT) AS most_common_rows,
       CAST(min(n) AS BIGINT) AS least_common_rows,
       (SELECT string_agg(decade, ',' ORDER BY first) FROM c2_census WHERE n = (SELECT min(n) FROM c2_census))
         AS least_common_decades,
       {r10('max(n) / min(n)', 'ratio_most_least')}
FROM c2_census"""

ORACLES["c2_embedding_manifest"] = C2_PHRASES + """
SELECT phrase_hash, min(phrase) AS phrase, 'pending' AS model_name,
       sha256('{"model_name": "pending", "phrase_hash": "' || phrase_hash || '"}') AS embedding_id,
       'not_generated' AS embedding_status
FROM c2_stats GROUP BY phrase_hash"""

# The default encoder: trigrams of the padded phrase, by the first 32 bits of their MD5 modulo 64, scaled to length 1.
_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (8 - i)}" for i in range(1, 9))
ORACLES["c2_real_embeddings"] = C2_PHRASES + f""",
grams AS (
  SELECT phrase_hash, phrase, md5(substr(' ' || phrase || ' ', unnest(range(1, length(phrase) + 1)), 3)) AS h
  FROM (SELECT DISTINCT phrase_hash, phrase FROM c2_stats)
),
buckets AS (SELECT phrase_hash, phrase, CAST(({_HEX}) % 64 AS INTEGER) AS b, count(*) AS n FROM grams GROUP BY ALL)
SELECT phrase_hash, phrase, 'hashed-trigram-64' AS model_name,
       sha256('{{"model_name": "hashed-trigram-64", "phrase_hash": "' || phrase_hash || '"}}') AS embedding_id,
       'generated' AS embedding_status, 64 AS dimension,
       CAST(count(*) AS INTEGER) AS used_buckets, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS buckets,
       round(sum(n) / sqrt(sum(n * n)), 4) AS total, round(sum(n * b) / sqrt(sum(n * n)), 3) AS weighted_total
FROM buckets GROUP BY phrase_hash, phrase"""

ORACLES["c2_inspect_targets"] = C2_PHRASES + C2_ASKED + f"""
SELECT a.asked, a.cleaned_phrase, a.phrase_hash, f.decade, {r10('f.target_probability', 'target_probability')},
       f.decade_raw_count, {r10('f.decade_score', 'decade_score')},
       CAST(row_number() OVER (PARTITION BY a.asked ORDER BY f.target_probability DESC, f.decade) AS INTEGER)
         AS target_rank,
       row_number() OVER (PARTITION BY a.asked ORDER BY f.target_probability DESC, f.decade) <= 5 AS is_top
FROM c2_asked a JOIN c2_features f USING (phrase_hash)"""

ORACLES["c2_inspect_timeline"] = C2_PHRASES + C2_ASKED + f"""
SELECT a.asked, a.cleaned_phrase, a.phrase_hash, t.year, t.decade, t.raw_count,
       {r10('t.normalized_frequency', 'normalized_frequency')}
FROM c2_asked a JOIN c2_timelines t USING (phrase_hash)"""

ORACLES["c2_dataset_counts"] = C2_PHRASES + """
SELECT 'phrases' AS dataset, CAST(count(*) AS BIGINT) AS rows FROM c2_phrases
UNION ALL SELECT 'phrase_timelines', count(*) FROM c2_timelines
UNION ALL SELECT 'phrase_statistics', count(*) FROM c2_stats
UNION ALL SELECT 'features', count(*) FROM c2_features
UNION ALL SELECT 'embeddings', count(DISTINCT phrase_hash) FROM c2_stats"""

ORACLES["c2_corpus_distribution"] = C2_PHRASES + """
SELECT 'phrase_rows_by_decade' AS section, decade, CAST(count(*) AS DOUBLE) AS value FROM c2_phrases GROUP BY decade
UNION ALL
SELECT 'phrase_frequency_by_decade', decade, CAST(coalesce(sum(frequency), 0) AS DOUBLE) FROM c2_phrases GROUP BY decade
UNION ALL
SELECT 'unique_phrases_by_decade', decade, CAST(count(DISTINCT phrase_hash) AS DOUBLE) FROM c2_phrases GROUP BY decade
UNION ALL
SELECT 'feature_rows_by_decade', decade, CAST(count(*) AS DOUBLE) FROM c2_features GROUP BY decade
UNION ALL
SELECT 'target_probability_by_decade', decade, round(coalesce(sum(target_probability), 0.0), 10)
FROM c2_features GROUP BY decade"""

ORACLES["c2_phrase_features"] = C2_MODEL + """,
c2_dp AS (SELECT DISTINCT phrase FROM c2_inputs),""" + features_ctes("c2_pf", "c2_dp", "phrase", "phrase") + """
SELECT phrase, CAST(len(feats) AS INTEGER) AS n_features, sha256(array_to_string(feats, '|')) AS features_hash
FROM c2_pf"""

ORACLES["c2_profile_prior"] = C2_MODEL + f"""
SELECT decade, decade_key, {r10('prior', 'prior')} FROM c2_prior"""

ORACLES["c2_profile_prior_balanced"] = C2_MODEL + f"""
SELECT decade, decade_key, {r10('prior_balanced', 'prior')} FROM c2_prior"""

ORACLES["c2_profile_weights"] = C2_MODEL + f"""
SELECT feature, {r10('weight', 'weight')}, uniform FROM c2_mweights"""

ORACLES["c2_profile"] = C2_MODEL + f"""
SELECT feature, decade, {r10('probability', 'probability')} FROM c2_mprofile"""

ORACLES["c2_profile_scores"] = C2_MODEL + f"""
SELECT id, decade, {r10('probability', 'probability')} FROM c2_idist"""

ORACLES["c2_predictions"] = C2_MODEL + f""",
c2_itop AS (
  SELECT id, decade AS top_decade, round(probability, 6) AS confidence FROM c2_idist
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY probability DESC, decade_key) = 1
),
c2_isize AS (
  SELECT id, CAST(len(list_filter(string_split_regex(phrase, '[{WS}]+'), lambda x: x <> '')) AS INTEGER) AS tc,
         CAST(length(phrase) AS INTEGER) AS cc
  FROM c2_inputs
),
c2_rows AS (
  SELECT id, id AS source FROM c2_inputs
  UNION ALL SELECT 'P' || CAST(CAST(substr(id, 2) AS BIGINT) - 1 AS VARCHAR), id FROM c2_inputs WHERE id <> 'P1'
),
c2_itext AS (
  SELECT id, string_agg(decade || ':' || CAST(CAST(round(round(probability, 6) * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY decade_key, decade) AS decades
  FROM c2_idist GROUP BY id
)
SELECT r.id, i.phrase, i.expected_decade,
       CASE WHEN s.tc = 1 THEN '1_token' WHEN s.tc <= 4 THEN '2_4_tokens' WHEN s.tc <= 8 THEN '5_8_tokens'
            WHEN s.tc <= 15 THEN '9_15_tokens' ELSE '16_plus_tokens' END AS input_size_group,
       s.tc AS token_count, s.cc AS char_count, s.cc > 90 AS over_90_chars,
       t.top_decade, t.confidence,
       CASE WHEN i.expected_decade IS NOT NULL AND i.expected_decade <> '' THEN t.top_decade = i.expected_decade END
         AS matches_expected, x.decades
FROM c2_rows r JOIN c2_inputs i ON i.id = r.source JOIN c2_itop t ON t.id = r.source JOIN c2_isize s ON s.id = r.source JOIN c2_itext x ON x.id = r.source"""


# ---------------------------------------------------------------------------
# Sampling, input sizes, input-set validation
# ---------------------------------------------------------------------------
ORACLES["c1_sampled_articles"] = "WITH " + C1_DOCS.lstrip() + """,
b AS (SELECT min(year) AS s, max(year) AS e FROM c1_docs),
plan_years AS (
  SELECT DISTINCT least(greatest(CAST(t.d AS INTEGER), b.s), b.e) AS year
  FROM b, range(CAST(b.s // 10 * 10 AS BIGINT), CAST(b.e // 10 * 10 + 1 AS BIGINT), 10) AS t(d)
),
plan AS (SELECT year, m AS month FROM plan_years, (VALUES (1), (4), (7), (10)) AS v(m))
SELECT year, month, CAST(count(*) AS BIGINT) AS articles
FROM c1_docs WHERE (year, month) IN (SELECT year, month FROM plan) GROUP BY year, month"""

_TOKENS = f"len(list_filter(string_split_regex(text, '[{WS}]+'), lambda x: x <> ''))"
ORACLES["c1_input_sizes"] = f"""
SELECT doc_id, CAST({_TOKENS} AS INTEGER) AS token_count, CAST(length(text) AS INTEGER) AS char_count,
       CASE WHEN {_TOKENS} = 1 THEN '1_token' WHEN {_TOKENS} <= 4 THEN '2_4_tokens'
            WHEN {_TOKENS} <= 8 THEN '5_8_tokens' WHEN {_TOKENS} <= 15 THEN '9_15_tokens'
            ELSE '16_plus_tokens' END AS input_size_group,
       length(text) > 90 AS over_90_chars
FROM documents"""

V_IN = """WITH v_in AS (
  SELECT p_name AS id, lower(p_type) AS phrase, CAST(1850 + (p_size % 20) * 10 AS VARCHAR) || 's' AS expected
  FROM part
),
decs AS (SELECT CAST(t.y AS VARCHAR) || 's' AS decade FROM range(1850, 2030, 10) AS t(y)),
v_counts AS (
  SELECT expected AS decade, CAST(count(*) AS BIGINT) AS n FROM v_in WHERE expected IN (SELECT decade FROM decs)
  GROUP BY expected
),
v_checked AS (
  SELECT decade, n FROM v_counts
  UNION ALL SELECT decade, 0 FROM decs WHERE NOT EXISTS (SELECT 1 FROM v_counts)
),
v_errors AS (
  SELECT 'missing id' AS error, coalesce(phrase, '') AS subject FROM v_in WHERE id IS NULL OR id = ''
  UNION ALL SELECT 'missing phrase', coalesce(id, '') FROM v_in WHERE phrase IS NULL OR phrase = ''
  UNION ALL SELECT 'invalid expected_decade', concat_ws(' ', coalesce(id, ''), 'expected_decade=' || expected)
    FROM v_in WHERE expected IS NOT NULL AND expected <> '' AND expected NOT IN (SELECT decade FROM decs)
  UNION ALL SELECT 'missing expected_decade', coalesce(id, '') FROM v_in WHERE expected IS NULL OR expected = ''
  UNION ALL SELECT 'duplicate id', id FROM v_in WHERE id IS NOT NULL AND id <> '' GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'decade below minimum', printf('decade %s has %d examples; expected at least %d', decade, n, 100)
    FROM v_checked WHERE n < 100
)"""

ORACLES["c2_validation_errors"] = V_IN + "\nSELECT error, subject FROM v_errors"
ORACLES["c2_validation_decades"] = V_IN + "\nSELECT decade, n AS rows FROM v_counts"
ORACLES["c2_validation_sizes"] = V_IN + f""",
v_sz AS (
  SELECT len(list_filter(string_split_regex(phrase, '[{WS}]+'), lambda x: x <> '')) AS tc
  FROM v_in WHERE phrase IS NOT NULL AND phrase <> ''
)
SELECT CASE WHEN tc = 1 THEN '1_token' WHEN tc <= 4 THEN '2_4_tokens' WHEN tc <= 8 THEN '5_8_tokens'
            WHEN tc <= 15 THEN '9_15_tokens' ELSE '16_plus_tokens' END AS input_size_group,
       CAST(count(*) AS BIGINT) AS rows
FROM v_sz GROUP BY 1"""
ORACLES["c2_validation_summary"] = V_IN + """
SELECT CAST((SELECT count(*) FROM v_in) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS errors, count(*) = 0 AS valid
FROM v_errors"""

V_GAPS = """
WITH g_in AS (
  SELECT p_name AS id, lower(p_type) AS phrase, CAST(1850 + (p_size % 20) * 10 AS VARCHAR) || 's' AS expected,
         (length(p_name) + length(p_type)) % 7 AS n, length(p_type) % 7 AS m
  FROM part
),
g AS (
  SELECT CASE WHEN n = 1 THEN NULL WHEN m = 2 THEN '' ELSE id END AS id,
         CASE WHEN n = 3 THEN NULL WHEN m = 4 THEN '' ELSE phrase END AS phrase,
         CASE WHEN n = 5 THEN NULL WHEN m = 6 THEN '' ELSE expected END AS expected
  FROM g_in
)"""
ORACLES["c2_validation_gaps"] = V_GAPS + """
SELECT 'missing id' AS error, coalesce(phrase, '') AS subject FROM g WHERE coalesce(id, '') = ''
UNION ALL SELECT 'missing phrase', coalesce(id, '') FROM g WHERE coalesce(phrase, '') = ''
UNION ALL SELECT 'missing expected_decade', coalesce(id, '') FROM g WHERE coalesce(expected, '') = ''
UNION ALL SELECT 'invalid expected_decade', coalesce(id, '') || ' expected_decade=' || expected FROM g
  WHERE coalesce(expected, '') <> '' AND NOT (regexp_matches(expected, '^[0-9]{4}s$') AND CAST(left(expected, 4) AS INTEGER) BETWEEN 1850 AND 2020)
UNION ALL SELECT 'duplicate id', id FROM g WHERE coalesce(id, '') <> '' GROUP BY id HAVING count(*) > 1"""
