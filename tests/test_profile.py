import pytest
from pyspark.sql import functions as F

from millrace.operators import profile as p
from millrace.operators.recipe import Recipe, default_recipe, parse_fenced_json, rule_recipe, validate_recipe


@pytest.fixture(scope="module")
def people(spark):
    ages = [25, 30, 35, 40, 28, 32, 45, 22, 38, 150]
    incomes = [50000, 60000, 55000, 70000, 52000, 58000, 65000, 48000, 62000, 1000000]
    rows = [(i, ages[i % 10], incomes[i % 10], "ABC"[i % 3]) for i in range(1000)]
    df = spark.createDataFrame(rows, "user_id long, age long, income long, city string")
    return df.withColumn("signup_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("user_id").cast("int")))


@pytest.fixture(scope="module")
def profile(people):
    return p.column_profile(people, ["user_id"])


def test_outliers_and_types(profile):
    rows = p.profile_rows(profile)
    assert rows["age"]["outlier_count"] == 100 and rows["income"]["outlier_count"] == 100
    assert rows["age"]["outlier_percentage"] == 10.0
    assert [rows[c]["type"] for c in ("user_id", "city", "signup_date")] == ["numeric", "categorical", "temporal"]
    assert rows["signup_date"]["is_monotonic"] is True
    assert rows["signup_date"]["min_date"] == "2020-01-01"
    assert [(v["value"], v["count"]) for v in rows["city"]["top_values"]] == [("A", 334), ("B", 333), ("C", 333)]
    assert rows["age"]["domain_hint"] == "age" and rows["user_id"]["domain_hint"] == "identifier"


def test_insights(profile):
    found = p.profile_insights(profile).first()
    assert found["target_candidates"] == ["city"] and found["has_temporal"] and found["numeric_columns"] == 3


def test_nulls_and_edge_columns(spark):
    schema = "a double, b string, c int, d double"
    rows = [(None, None, 1, 1.0), (None, None, None, float("nan")), (None, None, 3, 3.0), (None, None, 3, 5.0)]
    found = p.profile_rows(p.column_profile(spark.createDataFrame(rows, schema)))
    assert found["a"]["all_null"] and found["a"]["min"] is None and found["a"]["null_percentage"] == 100.0
    assert found["a"]["unique_count"] == 1  # null counts as a value
    assert found["b"]["all_null"] and found["b"]["is_high_cardinality"] is None
    assert found["c"]["unique_count"] == 3 and found["c"]["median"] == 3.0
    assert found["d"]["max"] == 5.0 and found["d"]["median"] == 3.0  # NaN takes no part
    insights = p.profile_insights(p.column_profile(spark.createDataFrame(rows, schema))).first()
    assert insights["target_candidates"] == []  # an all-null string is none


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string, c date")
    rows = p.profile_rows(p.column_profile(empty, ["a"]))
    assert all(r["null_count"] == 0 and r["unique_count"] == 0 and r["all_null"] for r in rows.values())


def test_single_value_has_zero_deviation(spark):
    row = p.profile_rows(p.column_profile(spark.createDataFrame([(4,)], "x int")))["x"]
    assert row["std"] == 0.0 and row["skewness"] == 0.0 and row["is_skewed"] is False


def test_percent_rounds_as_double(spark):
    df = spark.range(800).select(F.when(F.col("id") > 0, F.col("id")).alias("x"))
    assert p.null_counts(df).first()["null_percentage"] == round(1 / 800 * 100, 2) == 0.12


def test_sample_is_exact_and_stable(people):
    first = {r.user_id for r in p.profile_sample(people, ["user_id"], 137).collect()}
    again = {r.user_id for r in p.profile_sample(people.repartition(5), ["user_id"], 137).collect()}
    assert len(first) == 137 and first == again
    assert p.profile_sample(people, ["user_id"], 5000).count() == 1000


def test_default_and_rule_recipes(spark, people):
    df = people.withColumn("empty", F.lit(None).cast("string")).withColumn(
        "gap", F.when(F.col("user_id") % 10 != 0, F.col("age"))
    )
    profile = p.column_profile(df)
    basic = default_recipe(profile)
    assert (basic.target_column, basic.impute_strategy, basic.drop_columns) == ("city", "mode", ["empty"])
    ruled = rule_recipe(profile)
    assert ruled.outlier_strategy == "clip" and ruled.target_column == "city" and ruled.drop_columns == ["empty"]
    assert ruled.impute_strategy == "mean"


def test_validation(profile):
    recipe = Recipe("nope", "clip", "mean", {"age": "Float64", "x": "Int64"}, ["city", "y"], 0.5)
    checked = validate_recipe(recipe, profile)
    assert checked.target_column is None and checked.type_conversions == {"age": "Float64"}
    assert checked.drop_columns == ["city"] and checked.impute_strategy == "mean"
    with pytest.raises(ValueError):
        Recipe(outlier_strategy="squash")
    with pytest.raises(ValueError):
        Recipe(confidence=1.5)


def test_fenced_json(spark):
    texts = ['ok ```json\n{"a": 1}\n``` bye', '```\n{"a": 2}\n```', '{"a": 3}', "```json\n{broken\n```", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["parsed"]["a"] if r["parsed"] else None for r in parse_fenced_json(df, "t", "a int").orderBy("i").collect()]
    assert got == [1, 2, 3, None, None, None]


def test_long_texts_are_ranked_by_text(spark):
    long = "same beginning of all these texts, longer than what is compared at first: "
    values = [long + x for x in "dacb"] * 2 + [long + "z"] * 3 + ["short"] * 2 + [None] * 9 + ["other " + long]
    df = spark.createDataFrame([(v, "x") for v in values], "t string, s string")
    top = [(r.value, r["count"]) for r in p.top_values(df, ["t", "s"], 4).filter("column = 't'").orderBy("rank").collect()]
    assert top == [(long + "z", 3), (long + "a", 2), (long + "b", 2), (long + "c", 2)]
    counts = {r["column"]: (r.unique_count, r.distinct_values) for r in p.distinct_counts(df).collect()}
    assert counts == {"t": (8, 7), "s": (1, 1)}


def test_long_texts_do_not_travel(spark):
    from plans import plan_of

    df = spark.createDataFrame([("x" * 100,)], "t string")
    assert "sha2" in plan_of(p.distinct_counts(df))


def test_approximate_distinct_is_close(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 500).alias("k"), F.when(F.col("id") > 9, "x").alias("s"))
    got = {r["column"]: r for r in p.distinct_counts(df, exact=False).collect()}
    assert abs(got["id"].distinct_values - 20_000) < 2_500 and abs(got["k"].distinct_values - 500) < 60
    assert (got["s"].unique_count, got["s"].distinct_values) == (2, 1)


def test_insights_on_missing_columns(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 6, "a").alias("mostly_missing"))
    found = p.profile_insights(p.column_profile(df)).first()
    assert found["high_missing_columns"] == ["mostly_missing"] and not found["has_temporal"]


def test_many_long_values_with_a_common_beginning(spark, monkeypatch):
    """Ties are told apart by longer beginnings, not by ranking them all in one task."""
    common = "https://example.org/a/very/long/path/that/all/of/them/share/" * 2
    rows = [(f"{common}{i:05d}",) for i in range(20_000)] + [(f"{common}{i:05d}",) for i in (7, 9, 11, 13)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "url string").repartition(6)
    want = [(f"{common}{i:05d}", 2) for i in (7, 9, 11, 13)] + [(f"{common}00000", 1)]
    assert [(r["value"], r["count"]) for r in p.top_values(df, ["url"]).orderBy("rank").collect()] == want
    ranked = []
    plain = p._first_ranked

    def counting(counted, order, k):
        ranked.append(k)
        out = plain(counted, order, k)
        assert "WindowGroupLimit" in plan_text(out)
        return out

    monkeypatch.setattr(p, "_first_ranked", counting)
    monkeypatch.setattr(p, "MOST_POSSIBLE", 50)
    assert [(r["value"], r["count"]) for r in p.top_values(df, ["url"], 3).orderBy("rank").collect()] == want[:3]
    assert ranked and set(ranked) == {3}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
