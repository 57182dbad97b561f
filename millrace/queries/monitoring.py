"""Failure monitoring queries on events: ``error`` is a failure, the user is the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import monitor as m
from millrace.queries import texts  # noqa: F401  (registers license_detect, whose SQL the stream shares)
from millrace.queries.registry import ORACLES, query, table
from millrace.streaming.breaker import breaker_stream
from millrace.streaming.rowwise import drain, read_stream, stream_classify

ORDER = ["ts", "event_id"]
_RATED = (
    "select event_id, user_id, ts, fail, avg(fail::int) over w as failure_rate, count(*) over w = 10 as filled from"
    " (select *, event_type = 'error' as fail from events)"
    " window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)"
)


def requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("fail"))


@query(
    "rolling_failure_rate",
    f"select event_id, round(failure_rate, 6) as failure_rate, filled, fail and filled and failure_rate >= 0.3 as tripped"
    f" from ({_RATED})",
)
def _(spark, sf):
    rated = m.rolling_failure_rate(requests(spark, sf), "user_id", ORDER, "fail")
    return rated.select("event_id", F.round("failure_rate", 6).alias("failure_rate"), "filled", "tripped")


@query(
    "breaker_trips",
    f"select user_id, count(*) as trips, min(ts) as first_trip from ({_RATED}) where fail and filled and failure_rate >= 0.3"
    " group by 1",
)
def _(spark, sf):
    return m.breaker_trips(requests(spark, sf), "user_id", ORDER, "fail")


@query(
    "failure_stats",
    "select user_id, count(*) as total_requests, round(avg(fail::int), 6) as failure_rate, count(*) filter (where fail) as failures,"
    " count(*) filter (where not fail) as successes from (select user_id, event_type = 'error' as fail from events qualify"
    " row_number() over (partition by user_id order by ts desc, event_id desc) <= 10) group by 1",
)
def _(spark, sf):
    stats = m.failure_stats(requests(spark, sf), "user_id", ORDER, "fail")
    return stats.withColumn("failure_rate", F.round("failure_rate", 6))


@query("breaker_replay")
def _(spark, sf):
    return m.breaker_replay(requests(spark, sf), "user_id", ORDER, "fail")


@query("breaker_stream")
def _(spark, sf):
    events = table(spark, sf, "events")
    stream = read_stream(spark, sf, events.schema, "events.parquet")
    log = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("fail"))
    return drain(breaker_stream(log, "user_id", ORDER, "fail"), "breaker-stream")


@query("stream_classify", ORACLES["license_detect"])
def _(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    stream = read_stream(spark, sf, documents.schema, "documents.parquet")
    return drain(stream_classify(stream).drop("text"), "stream-classify")
