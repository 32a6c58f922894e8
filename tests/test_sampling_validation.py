"""Sampling plan and input-set validation."""

import pytest

from tempora.functions.sizes import input_size
from tempora.operators import sampling, validation
from pyspark.sql import functions as F


@pytest.mark.parametrize("start,end,years", [
    (1873, 1911, [1873, 1880, 1890, 1900, 1910]), (1900, 1900, [1900]), (1999, 2001, [1999, 2000]),
    (1941, 1949, [1941]), (1930, 1929, [])])
def test_sampled_years_as_list_and_as_plan(spark, start, end, years):
    assert sampling.one_year_per_decade(start, end) == years
    if years:
        plan = sampling.plan_frame(spark, start, end).collect()
        assert sorted((r["year"], r["month"]) for r in plan) == [(y, m) for y in years for m in sampling.SAMPLED_MONTHS]


def test_input_sizes(spark):
    frame = spark.createDataFrame([("lighthouse",), ("quay beside rope",), ("nine pilots led grain barges past sandbanks",),
                                   ("",), (" ".join(["w"] * 16),), ("x" * 91,)], "p string")
    got = [r[0].asDict() for r in frame.select(input_size(F.col("p"))).collect()]
    assert [g["group"] for g in got] == ["1_token", "2_4_tokens", "5_8_tokens", "2_4_tokens", "16_plus_tokens",
                                         "1_token"]
    assert got[5]["over_90_chars"] and not got[0]["over_90_chars"]


def test_validation_errors_and_summary(spark):
    rows = [("K7", "tin whistle", "1940s"), ("K7", "brass kettle", "1910s"), (None, "nameless", "1940s"), ("M2", "", "2030s"),
            ("N4", "oak chest", None)]
    frame = spark.createDataFrame(rows, "id string, phrase string, expected_decade string")
    errors = sorted((r["error"], r["subject"]) for r in
                    validation.validation_errors(frame, require_expected=True, min_per_decade=2).collect())
    assert ("duplicate id", "K7") in errors
    assert ("missing id", "nameless") in errors
    assert ("missing phrase", "M2") in errors
    assert ("invalid expected_decade", "M2 expected_decade=2030s") in errors
    assert ("missing expected_decade", "N4") in errors
    assert ("decade below minimum", "decade 1910s has 1 examples; expected at least 2") in errors
    summary = validation.validation_summary(frame, True, 2).first()
    assert summary["rows"] == 5 and not summary["valid"]


def test_validation_valid_set_and_all_decades_fallback(spark):
    frame = spark.createDataFrame([("K7", "tin whistle", "1940s"), ("K8", "brass kettle", "1970s")], "id string, phrase string, expected_decade string")
    assert validation.validation_summary(frame, require_expected=True).first()["valid"]
    empty = spark.createDataFrame([("K9", "oak chest", None)], "id string, phrase string, expected_decade string")
    low = validation.validation_errors(empty, min_per_decade=1).where("error = 'decade below minimum'").count()
    assert low == 18
