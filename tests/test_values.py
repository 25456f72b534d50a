import pytest
from pyspark.sql import functions as F

from qualframe.functions import dates, numbers, values
from qualframe.model import EMAIL, PHONE, Thresholds


def evaluate(spark, cells, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r["v"] for r in df.orderBy("i").select(make(F.col("c")).alias("v")).collect()]


def test_shapes_of_values(spark):
    cells = ["2026-01-05", "05/01/2026", "5 January 2026", "1,200.50", "$300", "N/A", "", "17%", "$ 5"]
    assert evaluate(spark, cells, values.is_date_like) == [True] * 3 + [False] * 6
    assert evaluate(spark, cells, values.is_numeric_like) == [False] * 3 + [True, True, False, False, True, False]


def test_number_shape_allows_signs_anywhere(spark):
    cells = ["1$2", "€-5", "-€5", "5£%", ".5", "5.", "1,,2", "--5", "1.2.3", "٣"]
    want = [True, True, True, True, True, False, True, False, False, True]
    assert evaluate(spark, cells, values.is_numeric_like) == want


def test_two_readings_of_numbers_differ(spark):
    cells = ["+7", "1e5", "inf", "1,,2", "$3", "12 %%", "1d", "nan", "pending", None, " 4 "]
    strict = [7.0, 1e5, float("inf"), None, None, None, None, None, None, None, 4.0]
    lenient = [7.0, 1e5, float("inf"), 12.0, 3.0, 12.0, None, None, None, None, 4.0]
    assert evaluate(spark, cells, numbers.strict_number) == strict
    assert evaluate(spark, cells, numbers.lenient_number) == lenient


def test_placeholders(spark):
    cells = ["", "  ", " N/A ", "None", "nil", "--", "#n/a", "n.a", "x", None]
    dtype = spark.createDataFrame([("",)], "c string").schema["c"].dataType
    assert evaluate(spark, cells, lambda c: values.is_blank(c, dtype)) == [True] * 7 + [False, False, True]
    assert evaluate(spark, cells, values.is_placeholder_text) == [False, False] + [True] * 5 + [False] * 3


def test_strip_takes_all_white_space(spark):
    cells = [" x　", "\t x\x1f\n", "x", " a b "]
    assert evaluate(spark, cells, values.strip) == [c.strip() for c in cells]


def test_title_case_is_that_of_python(spark):
    cells = ["o'neil MARY-jane 3rd", "école des BEAUX", "x", "", "a.b c"]
    assert evaluate(spark, cells, values.title_case) == [c.title() for c in cells]


def test_formats(spark):
    assert evaluate(spark, ["a@b.co", " a@b.co ", "a@b", "a b@c.de", "@c.de"], values.is_email) == [
        True, True, False, False, False,
    ]
    assert evaluate(spark, ["+1 (555) 0100", "12345", "call me", "5550100"], values.is_phone) == [
        True, False, False, True,
    ]
    names = ["Work E-Mail", "email2", "Mobile No", "Contact Number", "contact_1", "phone"]
    assert [values.expected_format(n) for n in names] == [EMAIL, EMAIL, PHONE, PHONE, None, PHONE]


@pytest.mark.parametrize("day_first, slashed", [(False, "2026-06-01"), (True, "2026-01-06")])
def test_dates_of_all_layouts(spark, day_first, slashed):
    cells = [
        "06/01/2026", "29/01/2026", "01/29/2026", "2026-1-5", "2026/01/05", "5 Jan 2026", "Sept 5, 2026",
        "2026-01-05 10:30", "31/02/2026", "5 Foo 2026", "x", None,
    ]
    want = [
        slashed, "2026-01-29", "2026-01-29", "2026-01-05", "2026-01-05", "2026-01-05", "2026-09-05",
        "2026-01-05", None, None, None, None,
    ]
    assert evaluate(spark, cells, lambda c: dates.iso_date(c, day_first)) == want


def test_day_first_needs_evidence(spark):
    def reading(cells):
        df = spark.createDataFrame([(c,) for c in cells], "c string")
        return df.agg(dates.is_day_first(F.col("c"))).first()[0]

    assert reading(["29/01/2026", "06/01/2026"]) is True
    assert reading(["06/01/2026"]) is False
    assert reading(["29/01/2026", "01/29/2026"]) is False
    assert reading(["2026-01-05", None]) is False


def test_thresholds_have_bounds():
    for wrong in ({"missing_warn_pct": 101}, {"outlier_iqr_multiplier": 0.5}, {"outlier_min_rows": 4}):
        with pytest.raises(ValueError):
            Thresholds(**wrong)


def test_cheap_flags_equal_the_patterns(spark):
    """The flags that skip patterns give the same answers as the patterns, over many odd texts."""
    ends = ["", " ", "\t", " ", "$", "€", "%", "-", "+", "A", "x", "é", "٣", "1", ".", ","]
    cores = ["", "5", "12", "1,2", "1e5", "inf", "5.", ".5", "1/1/2026", "2026-1-1", "1 May 2026", "May 1, 2026",
             "Sept 5 2026", "2026-01-05 10:30", "May ٣ ٢٠٢٦", "abc", "a1", "-", "1 2", "nan"]
    cells = sorted({a + c + b for a in ends for c in cores for b in ends})
    df = spark.createDataFrame([(c,) for c in cells], "value string")
    value = F.col("value")
    got = values.with_flags(values.with_stripped(df)).select(
        "value",
        "number",
        "date",
        "parseable",
        (F.col("s") == values.strip(value)).alias("stripped"),
        values.is_numeric_like(value).alias("want_number"),
        values.is_date_like(value).alias("want_date"),
        numbers.strict_number(value).isNotNull().alias("want_parseable"),
    )
    wrong = got.where(
        "not stripped or number != want_number or date != want_date or parseable != want_parseable"
    )
    assert wrong.collect() == []
