"""Scalar text functions: normalization, tokens, cleaning, context, features."""

import random
import string
import time
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempora.functions import text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def many(spark, expr, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in frame.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def test_normalize_collapses_runs_and_whitespace(spark):
    got = many(spark, text.normalize_text, [None, "", "  a!!!  b\t\n c ", "wait...  what??", "it’s", "ﬁne", "a b",
                                            "x\x1cy", "--a--"])
    assert got == ["", "", "a! b c", "wait. what?", "it's", "fine", "a b", "x y", "-a-"]


def test_tokenize_has_no_word_boundary(spark):
    assert one(spark, text.tokenize, "Über 3rd-x rock'n'roll, A-B") == ["ber", "rd-x", "rock'n'roll", "a-b"]


def test_clean_phrase_rules(spark):
    cases = {
        "Moon Landing": "moon landing",
        "dogs'": "dogs",
        "ab": None,                      # shorter than 3
        "the of": None,                  # all stopwords
        "x" * 91: None,                  # longer than 90
        "a1 2345 678": None,             # letter share under 0.55
        "aaaaah": None,                  # five equal characters in a row
        "--hello--": "hello",
        "The Cat's  Toy!!": "the cat's toy",
        "123": None,
    }
    got = dict(zip(cases, many(spark, text.clean_phrase, list(cases))))
    assert got == cases


TOKEN_CHARS = string.ascii_lowercase + string.digits + "'-"
token = st.builds(lambda first, rest: first + rest, st.sampled_from(string.ascii_lowercase),
                  st.text(alphabet=TOKEN_CHARS, max_size=8))
# The extractor only cleans windows whose raw first and last tokens are not
# stopwords; the property holds under that precondition.
window = (st.lists(st.one_of(token, st.sampled_from(["the", "of", "the'", "aaaaa", "it's", "x--", "y''"])),
                   min_size=1, max_size=4)
          .filter(lambda ts: ts[0] not in text.STOPWORDS and ts[-1] not in text.STOPWORDS)
          .map(" ".join))


@settings(max_examples=40, deadline=None)
@given(st.lists(window, min_size=1, max_size=25))
def test_window_cleaning_matches_general_cleaning(spark, windows):
    """The specialised cleaning of token windows equals the general one (the
    run-of-five rule is applied per token by the extractor)."""
    frame = spark.createDataFrame([(w,) for w in windows], "w string")
    rows = frame.select(
        "w",
        text.clean_phrase(F.col("w")).alias("general"),
        text.clean_token_window(F.col("w")).alias("window"),
        F.exists(F.split("w", " "), lambda t: t.rlike(r"([a-z0-9])\1{4,}")).alias("run")).collect()
    for r in rows:
        expected = None if r["run"] else r["window"]
        assert r["general"] == expected, r["w"]


def test_context_window(spark):
    frame = spark.createDataFrame([("Alpha beta gamma delta", "gamma"), ("Alpha, beta", "alpha beta"),
                                   ("xx telegraphic yy", "graph")], "t string, p string")
    got = [r[0] for r in frame.select(text.context_window(F.col("t"), F.col("p"), 6)).collect()]
    assert got == ["beta gamma delta", "Alpha, beta", "x telegraphic yy"]


def test_phrase_features(spark):
    frame = spark.createDataFrame([("Red Bolt!!",), ("  ",)], "p string")
    rows = text.with_phrase_features(frame, "p", "f").collect()
    features = rows[0]["f"]
    assert "w:red" in features and "b:red bolt" in features and "c3: re" in features and "c5:bolt " in features
    assert features == sorted(features) and len(features) == len(set(features)) == 24
    assert rows[1]["f"] == []


def test_nfkc_guard_only_sends_changing_texts(spark):
    flags = many(spark, text.nfkc_may_change, ["plain ascii", "café crème", "ﬁ ligature", "Ｆｕｌｌ", "é"])
    assert flags == [False, False, True, True, True]


def test_first_places_by_search_and_by_index(monkeypatch):
    """A phrase inside a longer word counts when it comes first; the index finds what single searches find."""
    draw = random.Random(4)
    for _ in range(200):
        lowered = "".join(draw.choice(["art", "party ", "the ", "é", "b", " ", "a-b'"]) for _ in range(draw.randrange(60)))
        phrases = sorted({lowered[i:i + draw.randrange(1, 9)] for i in range(0, len(lowered), 3)} | {"absent", "art", "party the"} - {""})
        wanted = [lowered.find(p) for p in phrases]
        assert text.first_places(lowered, phrases) == wanted
        with monkeypatch.context() as patch:
            patch.setattr(text, "PASS_WORK", -1)
            patch.setattr(text, "PASS_PHRASES", 3)
            assert text.first_places(lowered, phrases) == wanted


def test_phrase_contexts_equal_the_single_form(spark):
    rows = [("The Party, a jet ENGINE flew over the café wall twice", ["party", "jet engine", "art", "not there", "over the caf", "wall twice"]),
            ("", ["x"]), ("  short ", ["short"]), ("İstanbul is far away from the harbour of Genoa", ["far away", "genoa"])]
    frame = spark.createDataFrame(rows, "t string, p array<string>")
    got = frame.select(text.phrase_contexts(6)(F.col("t"), F.lower("t"), F.col("p")).alias("c")).collect()
    single = frame.select(F.posexplode("p"), "t").select("t", "pos", text.context_window(F.col("t"), F.col("col"), 6).alias("c"))
    assert sorted((r.t, r.pos, r.c) for r in single.collect()) == sorted((t, i, c) for (t, _), row in zip(rows, got) for i, c in enumerate(row.c))


def test_long_text_is_passed_over_once():
    """Two million characters with a hundred thousand phrases: one by one this would be 10**11 comparisons."""
    draw = random.Random(9)
    lowered = " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(300_000))
    phrases = [" ".join(pair) for pair in zip(lowered.split()[::3], lowered.split()[1::3])]
    start = time.monotonic()
    places = text.first_places(lowered, phrases)
    assert time.monotonic() - start < 60
    assert all(lowered.startswith(p, at) and at >= 0 for p, at in zip(phrases, places))
    assert [places[i] for i in range(0, 90_000, 9_000)] == [lowered.find(phrases[i]) for i in range(0, 90_000, 9_000)]


def test_nfkc_guard_searches_only_beyond_ascii(spark):
    """ASCII is never looked up among the class's ranges; whatever passes the guard is unchanged by NFKC."""
    assert "octet_length" in str(text.nfkc_may_change(F.col("t")))
    values = [f"a{chr(cp)}b" for cp in range(1, 0x3100) if not 0xD800 <= cp < 0xE000] + ["a\U0001d400", "e\u0301", "\u1100\u1161", "", "~"]
    flags = many(spark, text.nfkc_may_change, values)
    assert not any(flag and value.isascii() for flag, value in zip(flags, values))
    assert all(flag or unicodedata.normalize("NFKC", value) == value for flag, value in zip(flags, values))
    assert sum(not flag for flag in flags) > 900 and flags[-5:] == [True, True, True, False, False]
