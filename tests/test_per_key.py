from pyspark.sql import functions as F

from millrace.plans.per_key import join_per_key


def tables(spark):
    """A key with most rows, a null key, and a key per row."""
    df = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("key")
    )
    return df, df.groupBy(F.col("key").alias("_of")).agg(F.count("*").alias("_rows"), F.max("id").alias("last"))


def test_join_is_the_plain_one_however_keys_are_salted(spark):
    df, per_key = tables(spark)
    plain = {(r["id"], r["key"], r["last"]) for r in df.join(per_key, F.col("key").eqNullSafe(F.col("_of"))).collect()}
    for rows_per_salt in (1, 100, 599, 600, 10**6):
        out = join_per_key(df, per_key, {"key": "_of"}, ["id"], "_rows", rows_per_salt=rows_per_salt)
        assert out.columns == ["id", "key", "last"]
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == 6000 and set(rows) == plain
    assert set(map(tuple, join_per_key(df, per_key, {"key": "_of"}, ["id"], "_rows", small=True).collect())) == plain


def test_left_join_and_missing_keys(spark):
    df, per_key = tables(spark)
    some = per_key.filter("_of = 'hot' or _of = 'k8'")
    left = join_per_key(df, some, {"key": "_of"}, ["id"], "_rows", "left", rows_per_salt=50)
    assert left.count() == 6000 and left.filter("last is not null").count() == 4201
    assert join_per_key(df, some, {"key": "_of"}, ["id"], "_rows", rows_per_salt=50).count() == 4201
    assert join_per_key(df.limit(0), some, {"key": "_of"}, ["id"], "_rows").count() == 0
    assert join_per_key(df, some.limit(0), {"key": "_of"}, ["id"], "_rows").count() == 0


def test_rows_of_a_hot_key_meet_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, per_key = tables(spark)
        out = join_per_key(df, per_key, {"key": "_of"}, ["id"], "_rows", rows_per_salt=100).filter("key = 'hot'")
        tasks = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 4200 / 2
