import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from outrider.functions import bins, scalars


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_text_to_integer_rounds_half_away(spark):
    got = values(spark, scalars.integer_of_text(F.col("x")), ["2.5", "-2.5", "3.7", "1e3", "", None, "x", "99999999999"])
    assert got == [3, -3, 4, 1000, None, None, None, None]
    assert values(spark, scalars.integer_of_text(F.col("x"), "bigint"), ["9007199254740993"]) == [9007199254740993]


def test_double_to_integer_rounds_half_even(spark):
    assert values(spark, scalars.integer_of_double(F.col("x")), [2.5, 3.5, 2.7, None], "x double") == [2, 4, 3, None]


def test_calendar(spark):
    days = [date(2024, 1, 7), date(2024, 1, 8), None]
    assert values(spark, scalars.day_of_week(F.col("x")), days, "x date") == [0, 1, None]
    assert values(spark, scalars.days_after("2008-01-01", F.col("x")), [0, 31], "x int") == [datetime(2008, 1, 1), datetime(2008, 2, 1)]
    assert values(spark, scalars.date_of(F.col("x"), F.lit("2000-02-03")), ["2001-01-01", "no", None]) == [date(2001, 1, 1), date(2000, 2, 3), date(2000, 2, 3)]


def test_missing_lead_time_counts_as_the_longest(spark):
    x = F.col("x")
    assert values(spark, scalars.clipped(x, -1, 180), [None, -9, 500, 3], "x int") == [180, -1, 180, 3]
    assert values(spark, scalars.log1p_of(x), [None, -9, 0], "x int") == [0.0, 0.0, 0.0]
    assert values(spark, bins.lead_time_bin(x), [None, -1, 0, 1, 3, 8, 15, 31, 61], "x int") == ["61_plus", "same_day", "same_day", "1_2", "3_7", "8_14", "15_30", "31_60", "61_plus"]


def test_probabilities(spark):
    got = values(spark, scalars.logit(F.col("x")), [0.0, 0.5, 1.0, None], "x double")
    assert got[1] == 0 and got[3] is None and math.isfinite(got[0]) and math.isclose(got[0], -got[2], rel_tol=1e-2)
    assert values(spark, scalars.sigmoid(scalars.logit(F.col("x"))), [0.3], "x double")[0] == pytest.approx(0.3)


def test_bins(spark):
    x = F.col("x")
    assert values(spark, bins.cut(x, bins.LEAD_EDGES), [-0.1, 0.0, 2.0, 2.1, 180.0, 180.1, -1.0, None], "x double") == [0, 0, 1, 2, 6, None, None, None]
    assert bins.cut_labels(bins.LEAD_EDGES)[0] == "(-0.101, 0]"
    assert values(spark, bins.equal_width_bin(x), [0.0, 0.3, 0.6, 0.7, 1.0, None], "x double") == [0, 2 if 0.3 < 3 * 0.1 else 3, 6 if 0.6 >= 6 * 0.1 else 5, 7 if 0.7 >= 7 * 0.1 else 6, 9, None]
    assert values(spark, bins.equal_width_bin(x, closed_top=False), [0.99, 1.0], "x double") == [9, 10]
    assert values(spark, bins.quantile_bin(x, [0.0, 0.5, 0.5, 1.0]), [0.0, 0.5, 0.7], "x double") == [1, 1, 2]


def test_names():
    assert scalars.normalise_name(" No-show Day ") == "no_show_day"
    assert scalars.quote_ident("a`b") == "`a``b`"


def test_flags_and_hash(spark):
    assert values(spark, scalars.says_yes(F.col("x")), ["Yes", "no", None]) == [1, 0, 0]
    assert values(spark, scalars.flag(F.col("x") > 1), [2, 1, None], "x int") == [1, 0, 0]
    assert values(spark, scalars.portable_hash(F.col("x")), [1], "x bigint") == [0xC4CA4238]
    assert values(spark, scalars.unmarked(F.col("x")), ["?", "None", ""]) == [None, "None", ""]
