import datetime as dt
import re
from itertools import product

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import clean as c
from millrace.operators import dates as d
from millrace.operators.profile import column_profile
from millrace.operators.recipe import Recipe


def one_column(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


@pytest.mark.parametrize(
    "values, fmt",
    [
        (["2024-01-31", "2024-02-28", None, "2024-3-1"], "%Y-%m-%d"),
        (["31/01/2024", "28/02/2024"], "%d/%m/%Y"),
        (["01/31/2024", "02/28/2024"], "%m/%d/%Y"),
        (["20240131", "20240228"], "%Y%m%d"),
        (["31-Jan-2024", "28-Feb-2024"], "%d-%b-%Y"),
        (["Jan 31, 2024", "Feb 28, 2024"], "%b %d, %Y"),
        (["2024-01-31 10:30:00"], "%Y-%m-%d %H:%M:%S"),
        (["123", "456", "789"], None),
        (["2024-01-31"] * 9 + ["x"], None),  # exactly 90 % is not enough
        ([None, None], None),
    ],
)
def test_date_formats(spark, values, fmt):
    got = d.detect_date_formats(one_column(spark, values), ["i"]).filter("column = 'x'").first()["format"]
    assert got == fmt


def test_all_values_decide(spark):
    values = [None] * 300 + ["2024-01-05"] * 100 + ["no date"] * 200
    df = one_column(spark, values)
    assert d.date_formats(df) == {}
    assert d.auto_parse_dates(df).filter("x = 'no date'").count() == 200
    assert d.date_formats(df, ["i"], sample=100) == {"x": "%Y-%m-%d"}  # if asked for
    late = one_column(spark, ["no date"] * 10 + ["2024-01-05"] * 190)
    assert d.date_formats(late) == {"x": "%Y-%m-%d"}


def test_dates_of_empty_tables_and_odd_names(spark):
    assert d.date_formats(spark.createDataFrame([], "i int, x string")) == {}
    df = spark.createDataFrame([("2024-01-05", "$5", 3)], "`sold.on` string, `price``usd` string, `a b` int")
    got = c.smart_preprocess(df, ["a b"])
    assert got.columns == df.columns and tuple(got.first()) == (dt.date(2024, 1, 5), 5.0, 3)


def test_unix_unit_by_row(spark):
    df = spark.createDataFrame([(1700000000,), (1700000000000,), (None,), (1 << 62,)], "`t.s` long")
    days = [r[0] for r in d.parse_unix_ts(df, ["t.s"]).collect()]
    assert days == [dt.date(2023, 11, 14), dt.date(2023, 11, 14), None, None]
    assert d.detect_unix_ts(df).first()["is_unix"] is False
    assert d.detect_unix_ts(df.filter("`t.s` < 2e12")).first()["is_unix"] is True


def test_clip_keeps_values_inside(spark):
    import decimal

    exact = decimal.Decimal("9007199254740993.01")
    df = spark.createDataFrame([(2**53 + 1, exact), (5, exact + 1), (None, None)], "`a.b` long, d decimal(20,2)")
    stats = {
        "a.b": {"type": "numeric", "outlier_count": 1, "lower": 7.0, "upper": 1e300},
        "d": {"type": "numeric", "outlier_count": 1, "lower": 0.0, "upper": 1e17},
    }
    got = [tuple(r) for r in c.handle_outliers(df, "clip", stats).collect()]
    assert got == [(2**53 + 1, exact), (7, exact + 1), (None, None)]


def test_filling_with_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "`i.d` int, `v``x` double")
    assert [r[1] for r in c.impute_mean(df, ["v`x"]).collect()] == [2.0, 3.0, 4.0]
    assert [r[1] for r in c.impute_median(df, ["v`x"]).collect()] == [2.0, 3.0, 4.0]
    assert sorted(r[1] for r in c.forward_fill(df, ["v`x"], ["i.d"]).collect()) == [2.0, 2.0, 4.0]


def test_date_columns_by_type(spark):
    df = spark.range(3).select("id", F.current_date().alias("day"), F.lit("a").alias("t"))
    assert {r["column"]: r["is_date"] for r in d.date_columns(df, ["id"]).collect()} == {"id": False, "day": True, "t": False}


@pytest.mark.parametrize(
    "values, unix", [([1609459200, 1609545600], True), ([1609459200000, 1609545600000], True), ([1, 2, 3], False)]
)
def test_unix(spark, values, unix):
    df = spark.createDataFrame([(v,) for v in values], "ts long")
    assert d.detect_unix_ts(df, ["ts"]).first()["is_unix"] is unix
    if unix:
        days = [r.ts for r in d.parse_unix_ts(df, ["ts"], ["ts"]).collect()]
        assert days == [dt.date(2021, 1, 1), dt.date(2021, 1, 2)]


def test_mixed_types(spark):
    df = one_column(spark, ["25", " 30 ", "Unknown", "-", "$100", "1,234.5", "2 "])
    assert [r.x for r in c.coerce_mixed(df).orderBy("i").collect()] == [25.0, 30.0, None, None, 100.0, 1234.5, 2.0]
    below = one_column(spark, ["1", "2", "3", "x", "y"])
    assert c.coerce_mixed(below).schema["x"].dataType.simpleString() == "string"
    java_only = one_column(spark, ["10d", "5f", "0x1p3"])
    assert c.mixed_columns(java_only) == []
    assert c.mixed_columns(one_column(spark, [None, "", "NA"])) == []


def test_dates_come_before_numbers(spark):
    got = c.smart_preprocess(one_column(spark, ["20240131", "20240201"]), ["i"])
    assert got.schema["x"].dataType.simpleString() == "date"


def test_conversions(spark):
    df = spark.createDataFrame([("1,234", "x")], "n string, t string")
    got = c.convert_types(c.strip_commas(df, ["n", "gone"]), {"n": "Int32", "t": "Complex"})
    assert got.first() == (1234, "x") and got.schema["n"].dataType.simpleString() == "int"
    with pytest.raises(Exception):
        c.convert_types(df, {"t": "Int64"}).collect()
    assert c.convert_types(df, {"t": "Int64"}, on_error="null").first()["t"] is None


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("\ufeffname", "name\u200b", " age\u200c", "x")
    assert c.clean_headers(df).columns == ["name", "name_2", "age", "x"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("User ID", "user_id"), ("Total Purchase Amount ($)", "total_purchase_amount"), ("Is Active?", "is_active"),
        ("# of Orders", "of_orders"), ("already_fine", "already_fine"), ("Ünï", "n"),
    ],
)
def test_snake_names(name, want):
    assert c.snake_name(name) == want


@given(st.text())
def test_snake_is_idempotent(text):
    assert c.snake_name(c.snake_name(text)) == c.snake_name(text)


BOUNDS = {
    "age": {"type": "numeric", "outlier_count": 2, "lower": 20.0, "upper": 45.0, "null_percentage": 10.0},
    "income": {"type": "numeric", "outlier_count": 1, "lower": 40000.0, "upper": 90000.5, "null_percentage": 0.0},
    "gone": {"type": "numeric", "outlier_count": 1, "lower": 0.0, "upper": 1.0, "null_percentage": 50.0},
}


def test_clip_and_drop(spark):
    rows = [(1, 10, 50000), (2, 30, 10**6), (3, None, 45000), (4, 99, 60000), (5, 40, 60000)]
    df = spark.createDataFrame(rows, "id int, age int, income int")
    got = c.handle_outliers(df, "clip", BOUNDS).orderBy("id").collect()
    assert [r.age for r in got] == [20, 30, None, 45, 40] and got[1].income == 90000.5
    assert [r.id for r in c.handle_outliers(df, "drop", BOUNDS).orderBy("id").collect()] == [5]  # nulls go too
    assert c.handle_outliers(df, "keep", BOUNDS) is df


def test_missing(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 4, None), (3, 7, "b"), (4, None, "b")], "id int, age int, s string")
    stats = {**BOUNDS, "s": {"type": "categorical", "null_percentage": 25.0}}

    def filled(strategy):
        return [(r.age, r.s) for r in c.handle_missing(df, strategy, stats, ["id"]).orderBy("id").collect()]

    assert filled("mean") == [(5.5, "a"), (4.0, None), (7.0, "b"), (5.5, "b")]
    assert filled("median") == [(5.5, "a"), (4.0, None), (7.0, "b"), (5.5, "b")]
    assert filled("mode") == [(None, "a"), (4, "a"), (7, "b"), (7, "b")]  # leading gaps stay
    assert filled("drop_rows") == [(7, "b")]
    assert [r.s for r in c.impute_mode(df, ["s"]).orderBy("id").collect()] == ["a", "b", "b", "b"]


def test_recipe(spark):
    rows = [(i, 150 if i % 25 == 0 else 20 + i % 20, None if i % 10 == 3 else "AB"[i % 2], "2024-01-02", None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, age int, cat string, day string, junk string")
    profile = column_profile(df)
    recipe = Recipe("cat", "clip", "mode", {}, ["junk"], 0.9)
    cleaned, audit = c.apply_recipe(df, recipe, profile, ["id"])
    assert cleaned.columns == ["id", "age", "cat", "day"] and cleaned.count() == 200
    assert cleaned.schema["day"].dataType.simpleString() == "date"
    assert cleaned.filter("cat is null or age > 100").count() == 0
    assert [a for a, _ in audit.entries] == ["AUTO_PARSE_DATES", "DROP", "OUTLIERS", "MISSING"]
    same, log = c.apply_recipe(df, recipe, profile, ["id"], dry_run=True)
    assert same.columns == df.columns and [a for a, _ in log.entries] == [a for a, _ in audit.entries]
    assert c.apply_recipe(df, Recipe(impute_strategy="keep"), profile, ["id"])[0].columns == df.columns


def test_audit_counts(spark):
    df = spark.range(100).select("id", F.when(F.col("id") > 4, F.col("id") % 50).alias("v"))
    recipe = Recipe(impute_strategy="drop_rows")
    cleaned, audit = c.apply_recipe(df, recipe, column_profile(df), ["id"], observe=True)
    assert cleaned.count() == 95
    assert [(r.rows_before, r.rows_after) for r in audit.frame().collect()] == [(100, 95)]


def test_only_formats_that_can_fit_are_parsed(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(d, "parsed_date", lambda v, fmt, parsed=d.parsed_date: (tried.append(fmt), parsed(v, fmt))[1])
    days = ["31/12/2020"] * 10 + ["13/01/2021"] * 9 + ["2021-01-01", None, None]
    rows = [(day, f"${i},000", "x" * i, "31.02.2021" if i % 2 else "01.02.2021", None) for i, day in enumerate(days)]
    df = spark.createDataFrame(rows, "day string, price string, text string, half string, nothing string")
    found = {r["column"]: r["format"] for r in d.detect_date_formats(df).collect()}
    assert found == {"day": "%d/%m/%Y", "price": None, "text": None, "half": None, "nothing": None}
    assert sorted(tried) == ["%d.%m.%Y", "%d/%m/%Y", "%m.%d.%Y", "%m/%d/%Y"]


def test_forms_rule_out_no_date(spark):
    from millrace.functions import fixed_values as fixed
    from millrace.operators.dates import _forms, _shape, cell_form

    parts = {"yyyy": ["2024"], "yyyyMMdd": ["20240131", "2024131", "202411"], "MMM": ["Feb"]} | {p: ["1", "12"] for p in "MdHms"}
    rows = []
    for _, pattern in fixed.DATE_FORMATS:
        pieces = [parts.get(p, [p]) for p in re.findall("[A-Za-z]+|[^A-Za-z]+", pattern)]
        rows += [(pattern, "".join(chosen)) for chosen in product(*pieces)]
    found = spark.createDataFrame(rows, "pattern string, value string").withColumn("form", cell_form(F.col("value"))).collect()
    for row in found:
        assert re.match(_shape(row["pattern"]), row["value"]) and row["form"] in _forms(row["pattern"])
    odd = spark.createDataFrame([(None,), ("",), ("2024-01-01 and more words than a date has",)], "value string")
    assert [r[0] for r in odd.select(cell_form(F.col("value"))).collect()] == [None, "", None]
