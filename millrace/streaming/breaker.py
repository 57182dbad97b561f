"""The breaker as a stateful stream: the same transition code as the batch replay, one small state per key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.monitor import _AT, _FAIL, _KEY, Breaker, replay_batches


def breaker_stream(
    stream: DataFrame,
    key: str,
    order_by: list[str],
    fail: str,
    late: str | None = None,
    idle: str | None = None,
    **options,
) -> DataFrame:
    """Add ``allowed`` and ``state`` to a stream of requests; the first order column is the event time.

    Within a micro-batch requests run in order; across batches they are taken as they arrive. No request is left out and
    no state forgotten unless the caller says so: requests more than ``late`` behind the newest one seen are then beyond the
    watermark and left out by Spark, and a key without requests for ``idle`` of event time after that loses its state, so
    that the state store stays as small as the set of active keys. The breaker is sequential per key: a batch's rows of one key
    run in one task, so the batch size bounds what a hot key costs.
    """
    if idle is not None and late is None:
        raise ValueError("idle counts from the watermark, so it needs late")
    at = order_by[0]
    if isinstance(stream.schema[at].dataType, T.TimestampNTZType):
        stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    names = stream.columns
    fields = T.StructType(
        [*stream.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())]
    )
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        breaker = Breaker(**options)
        if state.exists:
            breaker.restore(tuple(json.loads(state.get[0])))
        rows = pd.concat(list(batches))  # one key's rows of one micro-batch
        for done in replay_batches(iter([rows]), breaker, order_by):
            yield done[[*names, "allowed", "state"]]
        state.update((json.dumps(breaker.snapshot()),))
        if idle_ms is not None:
            latest = int(rows[_AT].max() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)

    timed = stream if late is None else stream.withWatermark(at, late)
    tagged = timed.withColumns(
        {_KEY: F.col(key).cast("string"), _AT: F.unix_micros(at) / 1_000_000, _FAIL: F.col(fail)}
    )
    return tagged.groupBy(_KEY).applyInPandasWithState(
        run, fields, T.StructType([T.StructField("breaker", T.StringType())]), "append",
        GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout,
    )
