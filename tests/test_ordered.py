"""Sliced order operators against plain single-task windows, with slices small enough that hot keys span many."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plans import plan_of
from millrace.plans import ordered as o


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, two thirds of them under one key, half of them at one time."""
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id")).alias("t"),
        F.when((F.col("id") % 11 == 0) & ~F.col("id").between(600, 1900), F.col("id") * 1.5).alias("v"),
    )
    return rows.withColumn("s", F.when(F.col("id") > 20, F.concat(F.lit("x"), F.col("id") % 5)))


def test_hot_values_are_cut(hot):
    slices = o.fit_slices(hot, ["t", "id"], rows_per_slice=200)
    sizes = [r["count"] for r in slices.tag(hot).groupBy(o.SLICE).count().collect()]
    assert len(sizes) == slices.count == 15
    assert max(sizes) < 600  # the 1,500 rows at one time do not share a slice


def test_binary_search_equals_linear(hot, monkeypatch):
    slices = o.fit_slices(hot, ["t", "id"], rows_per_slice=100)
    few = slices.tag(hot).select("id", o.SLICE).orderBy("id").collect()
    monkeypatch.setattr(o, "FEW_BOUNDS", 0)
    assert few == slices.tag(hot).select("id", o.SLICE).orderBy("id").collect()


def test_bounds_use_no_more_columns_than_needed(hot):
    assert o.fit_slices(hot, ["id", "t"], rows_per_slice=200).order_by == ("id",)
    assert o.fit_slices(hot, ["t", "id"], rows_per_slice=200).order_by == ("t", "id")


@pytest.mark.parametrize("size", [150, 10_000])
def test_global_ordinal(hot, size):
    got = o.global_ordinal(hot, ["t", "id"], rows_per_slice=size)
    want = hot.withColumn("want", F.row_number().over(W.orderBy("t", "id")) - 1)
    both = got.join(want.select("id", "want"), "id")
    assert both.filter(F.col("ordinal") != F.col("want")).count() == 0
    assert both.count() == 3000


@pytest.mark.parametrize("keys", [None, ["k"]])
@pytest.mark.parametrize("size", [100, 10_000])
def test_forward_fill(hot, keys, size):
    got = o.forward_fill(hot, ["v", "s"], ["t", "id"], keys, rows_per_slice=size)
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("t", "id")
    want = hot.withColumns({c: F.last(c, True).over(w) for c in ("v", "s")})
    assert got.columns == hot.columns
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_forward_fill_has_no_single_task_window(hot):
    plan = plan_of(o.forward_fill(hot, ["v"], ["id"], rows_per_slice=300))
    wide = [line for line in plan.splitlines() if "Window" in line and "_slice" in line]
    assert wide and "hashpartitioning(_slice" in plan


def test_sorted_columns(hot):
    got = o.sorted_columns(hot, ["t", "id", "v"], ["id"], rows_per_slice=200)
    assert got == {"t": False, "id": True, "v": True}
    falls_at_bound = hot.withColumn("t", F.when(F.col("id") < 1500, F.col("id") + 1).otherwise(F.col("id") - 1))
    assert o.sorted_columns(falls_at_bound, ["t"], ["id"], rows_per_slice=100) == {"t": False}


def test_rows_at(hot, spark):
    found = o.rows_at(hot, ["t", "id"], [0, 1499, 2999, 5000], rows_per_slice=200)
    assert sorted(found) == [0, 1499, 2999]
    want = [tuple(r) for r in hot.orderBy("t", "id").select("t", "id").collect()]
    for p, literals in found.items():
        assert tuple(spark.range(1).select(*literals).first()) == want[p]


def test_empty_and_null_order(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert o.forward_fill(empty, ["v"], ["id"]).count() == 0
    assert o.global_ordinal(empty, ["id"]).count() == 0
    rows = spark.createDataFrame([(None, 1)] * 1 + [(i if i % 4 else None, i) for i in range(2, 400)], "a int, b int")
    got = o.global_ordinal(rows, ["a", "b"], rows_per_slice=40).orderBy("ordinal").select("a", "b").collect()
    assert got == rows.orderBy("a", "b").collect()


@pytest.mark.parametrize("n", [0, 1, 17, 1000, 1001, 2500, 4000])
def test_first_rows(hot, n):
    got = o.first_rows(hot, ["t", "id"], n, rows_per_slice=200)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in hot.orderBy("t", "id").limit(n).collect())


def test_order_columns_with_nulls(spark):
    rows = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("a"), "id")
    for n in (5, 20, 21, 45):
        got = o.first_rows(rows, ["a", "id"], n).select("id")
        assert sorted(got.collect()) == sorted(rows.orderBy("a", "id").limit(n).select("id").collect())


def test_slices_of_keyed_fills_are_worked_out_once_per_pass(spark):
    rows = spark.range(40_000).selectExpr("if(id % 4 = 3, null, id % 4) as k", "id as t", "if(id % 5 = 0, id, null) as v")
    bounds = o.fit_slices(rows, ["k", "t"], 2_000, at_least=1).bounds
    filled = o.forward_fill(rows, ["v"], ["t"], ["k"], rows_per_slice=2_000)
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert len(bounds) > 10 and plan.count(f"[{','.join(bounds[-1])}]") == 2
    want = rows.withColumn("v", F.expr("last(v, true) over (partition by k order by t)"))
    assert sorted(map(str, filled.collect())) == sorted(map(str, want.collect()))
