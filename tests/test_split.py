import pytest
from pyspark.sql import functions as F

from plans import plan_of
from millrace.operators import split as sp
from millrace.operators.profile import column_profile


def counts(df, *by):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*by, "split").count().collect()}


@pytest.fixture(scope="module")
def thousand(spark):
    return spark.range(1000).select("id", F.when(F.col("id") < 900, "A").otherwise("B").alias("label"))


def test_random_sizes(thousand):
    got = sp.split(thousand, "random", ["id"], ratios=(0.7, 0.2, 0.1))
    assert counts(got) == {("train",): 700, ("test",): 200, ("val",): 100}
    again = sp.split(thousand.repartition(7), "random", ["id"], ratios=(0.7, 0.2, 0.1))
    assert sorted(got.collect()) == sorted(again.collect())
    other = sp.split(thousand, "random", ["id"], ratios=(0.7, 0.2, 0.1), seed=7)
    assert sorted(got.collect()) != sorted(other.collect())


def test_rows_lost_to_rounding(spark):
    got = sp.split(spark.range(7), "random", ["id"])
    assert counts(got) == {("train",): 5, ("test",): 1}  # int(5.6) and int(1.4)


def test_random_split_shuffles_no_rows(thousand):
    assert "Exchange" not in plan_of(sp.split(thousand, "random", ["id"]))
    assert "Exchange" not in plan_of(sp.split(thousand, "temporal", order_by=["id"]))


def test_stratified(thousand, monkeypatch):
    want = {("A", "train"): 720, ("A", "test"): 180, ("B", "train"): 80, ("B", "test"): 20}
    broadcast = sp.split(thousand, "STRATIFIED", ["id"], target="label")
    assert counts(broadcast, "label") == want
    monkeypatch.setattr(sp, "BROADCAST_CLASSES", 1)
    salted = sp.split(thousand, "stratified", ["id"], target="label")
    assert "_salt" in plan_of(salted)
    assert sorted(salted.collect()) == sorted(broadcast.collect())


def test_stratified_nulls_and_tiny_classes(spark):
    rows = spark.range(103).select("id", F.when(F.col("id") < 100, "x").when(F.col("id") == 100, "solo").alias("c"))
    got = counts(sp.split(rows, "stratified", ["id"], target="c"), "c")
    assert got == {("x", "train"): 80, ("x", "test"): 20}
    kept = counts(sp.split(rows, "stratified", ["id"], target="c", ratios=(0.5, 0.25, 0.25), keep_nulls=True), "c")
    assert kept == {
        ("x", "train"): 50, ("x", "test"): 25, ("x", "val"): 25, ("solo", "val"): 1, (None, "train"): 1, (None, "val"): 1,
    }


def test_temporal(spark):
    days = spark.range(1000).select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    got = sp.split(days.repartition(9), "temporal", order_by=["day", "id"], ratios=(0.7, 0.2, 0.1))
    ends = {r["split"]: (r["a"], r["z"]) for r in got.groupBy("split").agg(F.min("day").alias("a"), F.max("day").alias("z")).collect()}
    assert ends["train"][1] < ends["test"][0] and ends["test"][1] < ends["val"][0]
    assert counts(got) == {("train",): 700, ("test",): 200, ("val",): 100}


def test_fast_is_close_and_stable(spark):
    got = sp.split(spark.range(20_000), "random", ["id"], mode="fast", ratios=(0.8, 0.1, 0.1))
    sizes = counts(got)
    assert abs(sizes[("train",)] - 16_000) < 400 and sum(sizes.values()) == 20_000
    more = sp.split(spark.range(30_000), "random", ["id"], mode="fast", ratios=(0.8, 0.1, 0.1))
    assert more.filter("id < 20000").join(got.withColumnRenamed("split", "s"), "id").filter("split <> s").count() == 0


def test_empty(spark):
    assert sp.split(spark.range(0), "random", ["id"]).count() == 0


def test_arguments(thousand):
    for bad in ({"strategy": "other"}, {"ratios": (0.5, 0.2, 0.1)}, {"strategy": "stratified"}, {"strategy": "temporal"}):
        with pytest.raises(ValueError):
            sp.split(thousand, **{"key": ["id"], **bad})


def test_distribution_and_detection(spark, thousand):
    shares = sp.split_distribution(sp.split(thousand, "stratified", ["id"], target="label"), "label")
    assert {r.share for r in shares.collect()} == {0.9, 0.1}
    assert sp.detect_strategy(column_profile(thousand, ["id"]), "label") == "stratified"
    assert sp.detect_strategy(column_profile(thousand, ["id"])) == "random"
    dated = thousand.withColumn("at", F.timestamp_seconds("id"))
    assert sp.detect_strategy(column_profile(dated, ["id"]), "label") == "temporal"


def test_names_with_dots_and_backticks(spark):
    from millrace.plans.ordered import global_ordinal

    plain = spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("c"), (1000 - F.col("id")).alias("t"))
    odd = plain.toDF("a.id", "the`class", "t.x")
    for strategy, more in (("random", {}), ("stratified", {"target": "c"}), ("temporal", {})):
        names = {"key": ["id"], "order_by": ["t"], **more}
        renamed = {"key": ["a.id"], "order_by": ["t.x"], **({"target": "the`class"} if more else {})}
        want = sorted(map(tuple, sp.split(plain, strategy, **names).collect()))
        got = sp.split(odd, strategy, **renamed)
        assert got.columns == [*odd.columns, "split"] and sorted(map(tuple, got.collect())) == want
    ordinals = {r[0]: r["ordinal"] for r in global_ordinal(odd, ["t.x"]).collect()}
    assert ordinals == {i: 199 - i for i in range(200)}
