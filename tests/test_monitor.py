import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import monitor as m
from millrace.streaming.breaker import breaker_stream
from millrace.streaming.rowwise import drain, read_stream


@pytest.fixture(scope="module")
def log(spark):
    """4,000 requests; one key makes two thirds of them, failures come in bursts."""
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(4000):
        at += rng.choice([0, 1, 1, 2, 40])
        key = "hot" if rng.random() < 0.66 else f"k{rng.randrange(25)}"
        rows.append((i, key, at, rng.random() < (0.7 if (i // 150) % 3 == 0 else 0.05)))
    df = spark.createDataFrame(rows, "id long, k string, sec long, fail boolean")
    return df.select("id", "k", F.timestamp_seconds("sec").alias("ts"), "fail")


def test_rule():
    b = m.Breaker(threshold=0.5, window=5)
    for failed in (True, True, True, False, False):
        b.step(failed, 0.0)
    assert b.state == m.CLOSED  # the window fills with a success, and only failures are tested
    b = m.Breaker(threshold=0.5, window=5)
    for _ in range(5):
        b.step(True, 0.0)
    assert b.state == m.OPEN
    assert b.step(True, 59.0) == (False, m.OPEN)
    assert b.step(False, 60.0) == (True, m.CLOSED)
    assert b.step(True, 61.0) == (True, m.OPEN)  # the window was kept


def test_half_open_allows_few():
    b = m.Breaker(threshold=1.0, window=3, probes=2)
    b.restore((m.HALF_OPEN, "SFF", 0.0, 0))
    assert [b.step(True, t)[0] for t in (1.0, 2.0, 3.0)][:1] == [True]
    full = m.Breaker(threshold=1.1, window=3, probes=2).restore((m.HALF_OPEN, "SSS", 0.0, 0))
    assert [full.step(True, 1.0) for _ in range(4)] == [
        (True, m.HALF_OPEN), (True, m.HALF_OPEN), (False, m.HALF_OPEN), (False, m.HALF_OPEN),
    ]


@pytest.mark.parametrize("size", [100, 300, 10_000])
def test_rolling(log, size):
    got = m.rolling_failure_rate(log, "k", ["ts", "id"], "fail", rows_per_slice=size)
    w = W.partitionBy("k").orderBy("ts", "id").rowsBetween(-9, 0)
    want = log.withColumn("r", F.avg(F.col("fail").cast("int")).over(w)).withColumn("n", F.count("*").over(w) == 10)
    both = got.join(want.select("id", "r", "n"), "id")
    assert both.count() == 4000
    assert both.filter((F.abs(F.col("failure_rate") - F.col("r")) > 1e-12) | (F.col("filled") != F.col("n"))).count() == 0


def plain_replay(log):
    breakers, result = {}, {}
    for r in log.select("id", "k", F.unix_seconds("ts").alias("s"), "ts", "fail").orderBy("ts", "id").collect():
        result[r.id] = breakers.setdefault(r.k, m.Breaker()).step(r.fail, float(r.s))
    return result


@pytest.mark.parametrize("size", [60, 500, 10_000])
def test_replay_is_exact_for_hot_keys(log, size):
    got = m.breaker_replay(log, "k", ["ts", "id"], "fail", rows_per_slice=size)
    assert {r.id: (r.allowed, r.state) for r in got.collect()} == plain_replay(log)


def test_stream_equals_replay(spark, log, tmp_path):
    parts = log.withColumn("part", F.floor(F.col("id") / 1000))
    for i in range(4):  # one file per micro-batch, in time order
        parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = read_stream(spark, str(tmp_path / "log"), log.schema, "*.parquet", files_per_batch=1)
    done = drain(breaker_stream(stream, "k", ["ts", "id"], "fail", late="1000 days"), "stream-test")
    assert {r.id: (r.allowed, r.state) for r in done.collect()} == plain_replay(log)


def test_stream_by_default_leaves_nothing_out(spark, log, tmp_path):
    spread = log.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") * 1000))  # keys rest for hours
    parts = spread.withColumn("part", F.floor(F.col("id") / 1000))
    for name, order in (("in", [0, 1, 2, 3]), ("back", [3, 2, 1, 0])):
        for i in order:
            parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = read_stream(spark, str(tmp_path / name), spread.schema, "*.parquet", files_per_batch=1)
        done = {r.id: (r.allowed, r.state) for r in drain(breaker_stream(stream, "k", ["ts", "id"], "fail"), f"stream-{name}").collect()}
        assert len(done) == 4000
        assert name == "back" or done == plain_replay(spread)


def test_stats(log):
    stats = {r.k: r for r in m.failure_stats(log, "k", ["ts", "id"], "fail").collect()}
    last = [r.fail for r in log.filter("k = 'hot'").orderBy("ts", "id").collect()][-10:]
    assert stats["hot"].failures == sum(last) and stats["hot"].total_requests == 10
    assert stats["hot"].successes == 10 - sum(last)


def test_classifying_a_stream_equals_the_batch(spark, sf):
    from millrace.operators.licenses import detect_license
    from millrace.streaming.rowwise import stream_classify

    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    stream = read_stream(spark, sf, documents.schema, "documents.parquet")
    done = drain(stream_classify(stream).drop("text"), "stream-classify-test")
    assert sorted(done.collect()) == sorted(detect_license(documents, "text").drop("text").collect())


def test_a_table_of_many_files_is_streamed_whole(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    documents.limit(1).write.parquet(str(tmp_path / "other_documents.parquet"))
    stream = read_stream(spark, str(tmp_path), documents.schema, "documents.parquet", files_per_batch=2)
    assert sorted(drain(stream, "stream-table-test").collect()) == sorted(documents.collect())


def test_slices_by_key_alone_keep_keys_whole(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 300).alias("k"), (F.col("id") % 7 == 0).alias("fail"))
    log = rows.withColumn("ts", F.timestamp_seconds("id"))
    got = m.breaker_replay(log, "k", ["ts", "id"], "fail", rows_per_slice=100)
    whole = m.breaker_replay(log, "k", ["ts", "id"], "fail")
    assert sorted(got.collect()) == sorted(whole.collect())
