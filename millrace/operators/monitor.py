"""Failure monitoring over request logs: rolling failure rates and a replay of the three-state breaker.

Hot keys are split by slices of (key, time): a rolling frame gets the few rows it needs from earlier slices, and the
replay carries the state from slice to slice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fixed_values as fixed
from millrace.plans.ordered import ROWS_PER_SLICE, SLICE, fit_slices, preceding_rows


def rolling_failure_rate(
    df: DataFrame,
    key: str,
    order_by: list[str],
    fail: str,
    n: int = fixed.FAILURE_WINDOW,
    threshold: float = fixed.FAILURE_THRESHOLD,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``failure_rate`` over the last ``n`` outcomes per key, ``filled`` and ``tripped``.

    A key trips on a failure with a full window and a rate at or above the threshold.
    """
    order = [key, *[c for c in order_by if c != key]]
    slices = fit_slices(df, order, rows_per_slice, at_least=1)
    tagged = slices.place(df)
    if slices.bounds and len(slices.order_by) > 1:
        before = preceding_rows(slices.tag(df), slices, [key], order_by, [fail], n - 1)
        tagged = tagged.withColumn("_own", F.lit(True)).unionByName(
            before.withColumn("_own", F.lit(False)), allowMissingColumns=True
        )
    else:
        tagged = tagged.withColumn("_own", F.lit(True))
        # bounds by key alone: no key reaches over a bound
    last = Window.partitionBy(SLICE, key).orderBy(*order_by).rowsBetween(-(n - 1), 0)
    rated = tagged.withColumns(
        {"failure_rate": F.avg(F.col(fail).cast("int")).over(last), "filled": F.count("*").over(last) == n}
    ).filter("_own")
    trip = F.col(fail) & F.col("filled") & (F.col("failure_rate") >= threshold)
    return rated.select(*df.columns, "failure_rate", "filled", trip.alias("tripped"))


def breaker_trips(df: DataFrame, key: str, order_by: list[str], fail: str, **options) -> DataFrame:
    """Keys with the number of trips and the first of them."""
    rated = rolling_failure_rate(df, key, order_by, fail, **options)
    return (
        rated.filter("tripped")
        .groupBy(key)
        .agg(F.count("*").alias("trips"), F.min(order_by[0]).alias("first_trip"))
    )


def failure_stats(
    df: DataFrame, key: str, order_by: list[str], fail: str, n: int = fixed.FAILURE_WINDOW
) -> DataFrame:
    """Per key over its last ``n`` outcomes: requests, failure rate, failures, successes. Limited before the shuffle."""
    latest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_by])
    recent = df.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n)
    failures = F.count_if(F.col(fail))
    return recent.groupBy(key).agg(
        F.count("*").alias("total_requests"),
        (failures / F.count("*")).alias("failure_rate"),
        failures.alias("failures"),
        (F.count("*") - failures).alias("successes"),
    )


# --- breaker ---

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class Breaker:
    """The state of one key: closed, open for a while after too many failures, then half open for a few probes.

    Only allowed requests are recorded. A success while half open closes the breaker and keeps the outcome window; a
    failure opens it only by the rate over a full window.
    """

    def __init__(
        self,
        threshold: float = fixed.FAILURE_THRESHOLD,
        window: int = fixed.FAILURE_WINDOW,
        open_seconds: float = fixed.OPEN_SECONDS,
        probes: int = fixed.HALF_OPEN_PROBES,
    ) -> None:
        self.threshold, self.window, self.open_seconds, self.probes = threshold, window, open_seconds, probes
        self.state = CLOSED
        self.outcomes: deque[bool] = deque(maxlen=window)
        self.opened_at = 0.0
        self.used = 0

    def snapshot(self) -> tuple:
        """Everything later decisions depend on, in a form that can be compared and stored."""
        text = "".join("F" if f else "S" for f in self.outcomes)
        opened = self.opened_at if self.state == OPEN else 0.0
        return self.state, text, opened, self.used if self.state == HALF_OPEN else 0

    def restore(self, snapshot: tuple) -> Breaker:
        self.state, text, self.opened_at, self.used = snapshot
        self.outcomes = deque((c == "F" for c in text), maxlen=self.window)
        return self

    def allows(self, now: float) -> bool:
        if self.state == OPEN and now - self.opened_at >= self.open_seconds:
            self.state, self.used = HALF_OPEN, 0
            return True
        if self.state == HALF_OPEN:
            free = self.used < self.probes
            self.used += free
            return free
        return self.state == CLOSED

    def record(self, failed: bool, now: float) -> None:
        self.outcomes.append(failed)
        if not failed:
            if self.state == HALF_OPEN:
                self.state, self.used = CLOSED, 0
        elif len(self.outcomes) == self.window and sum(self.outcomes) / self.window >= self.threshold:
            if self.state != OPEN:
                self.state, self.opened_at = OPEN, now

    def step(self, failed: bool, now: float) -> tuple[bool, str]:
        """Whether the request is allowed, and the state after it."""
        allowed = self.allows(now)
        if allowed:
            self.record(failed, now)
        return allowed, self.state


_KEY, _AT, _FAIL = "_key", "_at", "_fail"


def replay_group(rows: pd.DataFrame, start: dict, options: dict) -> tuple[pd.DataFrame, dict]:
    """Run the rows of one slice, ordered by key and time, from given states; also return the last state per key."""
    allowed, states, ends = [], [], {}
    breaker, current = None, None
    for key, at, failed in zip(rows[_KEY], rows[_AT], rows[_FAIL]):
        if breaker is None or key != current:
            current = key
            breaker = Breaker(**options)
            if key in start:
                breaker.restore(start[key])
        ok, state = breaker.step(bool(failed), at)
        allowed.append(ok)
        states.append(state)
        ends[key] = breaker.snapshot()
    return rows.assign(allowed=allowed, state=states), ends


def breaker_replay(
    df: DataFrame,
    key: str,
    order_by: list[str],
    fail: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    **options,
) -> DataFrame:
    """Add ``allowed`` and ``state`` to every request, as the breaker would have decided. First order column: the time.

    The replay of a key is sequential, so keys that fill several slices are settled in rounds: each slice of such a
    key first runs from a fresh breaker, all slices at once; then only slices whose true start differs from the one
    they ran from are run again, until no start changes. A breaker forgets its start after a few requests, so two or
    three rounds are usual; the result is exact in any case. Rounds touch rows of such keys only, and the driver holds
    one small state per slice.
    """
    order = [key, *[c for c in order_by if c != key]]
    slices = fit_slices(df, order, rows_per_slice, at_least=1)
    tagged = slices.tag(df).withColumns(
        {
            _KEY: F.col(key).cast("string"),
            _AT: F.unix_micros(F.col(order_by[0]).cast("timestamp")) / 1_000_000,
            _FAIL: F.col(fail),
        }
    )
    starts = _settled_starts(tagged, slices, key, order_by, options) if len(slices.order_by) > 1 else {}
    fields = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())])
    names = list(df.columns)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([_KEY, *order_by], kind="stable")
        done, _ = replay_group(rows, starts.get(int(rows[SLICE].iloc[0]), {}), options)
        return done[[*names, "allowed", "state"]]

    if not slices.bounds:
        # a small table has a single slice: keys spread the work instead
        return tagged.groupBy(_KEY).applyInPandas(run, fields)
    return tagged.groupBy(SLICE, *([] if len(slices.order_by) > 1 else [_KEY])).applyInPandas(run, fields)


def _settled_starts(tagged: DataFrame, slices, key: str, order_by: list[str], options: dict) -> dict[int, dict]:
    """Start state of the first key of each slice, for keys that reach over slice bounds."""
    goes_on = F.col(key).eqNullSafe(slices.bound_value(key, F.col(SLICE))) & (F.col(SLICE) < len(slices.bounds))
    narrow = tagged.filter(goes_on).select(SLICE, _KEY, _AT, _FAIL, *order_by)
    fresh = Breaker(**options).snapshot()
    schema = f"{SLICE} int, {_KEY} string, state string, outcomes string, opened double, used int"

    def ends_from(starts: dict[int, dict]):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            number = int(rows[SLICE].iloc[0])
            rows = rows.sort_values([_KEY, *order_by], kind="stable")
            _, ends = replay_group(rows, starts.get(number, {}), options)
            found = [(number, k, *s) for k, s in ends.items()]
            return pd.DataFrame(found, columns=[SLICE, _KEY, "state", "outcomes", "opened", "used"])

        return run

    ran_from: dict[int, tuple] = {}  # slice -> start state of its key in the last run
    ended: dict[int, tuple] = {}  # slice -> (key, end state)
    todo: list[int] | None = None
    starts: dict[int, dict] = {}
    while todo is None or todo:
        rows = narrow if todo is None else narrow.filter(F.col(SLICE).isin(todo))
        for r in rows.groupBy(SLICE).applyInPandas(ends_from(starts), schema).collect():
            number = r[SLICE]
            ended[number] = (r[_KEY], (r["state"], r["outcomes"], r["opened"], r["used"]))
            ran_from[number] = starts.get(number, {}).get(r[_KEY], fresh)
        starts = {n + 1: {k: s} for n, (k, s) in ended.items()}
        todo = [
            n for n, (k, _) in ended.items() if starts.get(n, {}).get(k, fresh) != ran_from[n]
        ]
    return starts


def replay_batches(
    batches: Iterator[pd.DataFrame], breaker: Breaker, order_by: list[str]
) -> Iterator[pd.DataFrame]:
    """Run one key's batches in order through a breaker."""
    for rows in batches:
        rows = rows.sort_values(order_by, kind="stable")
        results = [breaker.step(bool(f), at) for f, at in zip(rows[_FAIL], rows[_AT])]
        yield rows.assign(allowed=[a for a, _ in results], state=[s for _, s in results])
