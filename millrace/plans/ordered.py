"""Work that depends on row order, spread over many tasks.

Spark rows have no order, so every function takes ``order_by``; its columns together must be unique, else the order
among equal rows is open. A window without partitioning would put the whole table into one task, and one partitioned
by a key would put a hot key into one task. Instead the ordered rows are cut into *slices* of about equal size:

* ``fit_slices`` draws a small sample of the ordering columns and takes evenly spaced rows of it as slice bounds;
* ``tag`` gives each row its slice number by binary search among the bounds, which are literals in the plan, so a
  recomputed task always yields the same slices and nothing has to be materialised between passes;
* a window partitioned by slice does the local work, and what has to cross from one slice to the next (an offset, a
  last value, a few neighbouring rows) is first reduced to a bounded number of rows per slice.

Bounds use all ordering columns, so a single hot value is cut as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import all_of

ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 50_000
SAMPLE_PER_SLICE = 20
FEW_ROWS = 1000
FEW_BOUNDS = 64  # up to here comparing with each bound is cheaper than a binary search
SLICE = "_slice"
_SEP = "\x1f"


def typed_literal(text: str | None, dtype: T.DataType) -> Column:
    return F.lit(text).cast(dtype)


def literal_array(values: list, dtype: T.DataType) -> Column:
    """A constant array column of any length from one string literal (folded by the optimizer)."""
    text = _SEP.join("" if v is None else str(v) for v in values)
    parts = F.split(F.lit(text), _SEP, -1)
    return parts if isinstance(dtype, T.StringType) else parts.try_cast(T.ArrayType(dtype))


@dataclass(frozen=True)
class Slices:
    """Slice bounds over the ordering columns; ``bounds[i]`` is the first possible row of slice ``i + 1``."""

    order_by: tuple[str, ...]
    types: tuple[T.DataType, ...]
    bounds: tuple[tuple[str | None, ...], ...]

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def bound_value(self, column: str, position: Column) -> Column:
        """The value of an ordering column in the bound at a 0-based position; null outside the bounds."""
        at = self.order_by.index(column)
        values = literal_array([b[at] for b in self.bounds], self.types[at])
        return F.when((position >= 0) & (position < len(self.bounds)), F.get(values, position))

    def number(self) -> Column:
        """Slice number of a row: how many bounds are not above it."""
        if not self.bounds:
            return F.lit(0)
        size = len(self.bounds)

        def as_row(values: list[Column]) -> Column:
            if len(values) == 1:
                return values[0]
            return F.struct(*[v.alias(c) for v, c in zip(values, self.order_by)])

        row = as_row([F.col(c) for c in self.order_by])
        if size <= FEW_BOUNDS:
            result = F.lit(0)
            for b in self.bounds:
                bound = as_row([typed_literal(v, t) for v, t in zip(b, self.types)])
                result = result + F.when(bound <= row, 1).otherwise(0)
            return result
        arrays = [literal_array([b[i] for b in self.bounds], t) for i, t in enumerate(self.types)]
        steps = [1 << k for k in range(size.bit_length() - 1, -1, -1)]

        def probe(found: Column, step: Column) -> Column:
            at = found + step
            bound = as_row([F.get(a, at - 1) for a in arrays])
            return F.when((at <= size) & (bound <= row), at).otherwise(found)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)

    def tag(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLICE, self.number())

    def place(self, df: DataFrame) -> DataFrame:
        """Tag, and bring each slice together, with as many partitions as there are slices.

        Windows and groups by slice need no further shuffle, and tasks stay small however large the table is.
        """
        tagged = self.tag(df)
        return tagged.repartition(self.count, SLICE) if self.bounds else tagged


def _as_text(order_by: list[str]) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in order_by]


def fit_slices(
    df: DataFrame,
    order_by: list[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    min_slices: int = 1,
    at_least: int = 1,
    seed: int = 7,
) -> Slices:
    """Choose slice bounds. Small inputs get one slice; ``min_slices`` asks for parallelism on mid-sized ones.

    Bounds keep only as many leading columns (``at_least`` those) as it takes to tell them apart: one for a column
    without hot values, more where one value fills several slices.
    """
    types = tuple(df.schema[c].dataType for c in order_by)
    narrow = df.select(*order_by)
    total = narrow.count()
    wanted = min(max(math.ceil(total / rows_per_slice), min(min_slices, total // 20_000)), MAX_SLICES)
    if wanted <= 1:
        return Slices(tuple(order_by), types, ())
    fraction = min(1.0, SAMPLE_PER_SLICE * wanted / total)
    drawn = narrow if fraction == 1.0 else narrow.sample(fraction=fraction, seed=seed)
    # at most about SAMPLE_PER_SLICE * MAX_SLICES narrow rows, whatever the table size
    rows = [tuple(r) for r in drawn.orderBy(*order_by).select(*_as_text(order_by)).collect()]
    picked = [rows[i * len(rows) // wanted] for i in range(1, wanted)] if rows else []
    picked = list(dict.fromkeys(picked))
    width = at_least
    while width < len(order_by) and len({r[:width] for r in picked}) < len(picked):
        width += 1
    types = types[:width]
    bounds = [
        r[:width]
        for r in picked
        # literals cannot spell such bounds; leaving one out only makes a slice larger
        if not (width == 1 and r[0] is None)
        and not any(isinstance(t, T.StringType) and (v is None or _SEP in v) for v, t in zip(r, types))
    ]
    return Slices(tuple(order_by[:width]), types, tuple(dict.fromkeys(bounds)))


def _parallelism(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def up_to(df: DataFrame, order_by: list[str], last: list[Column]) -> DataFrame:
    """Rows not after the row with the given ordering values; the first column's range reaches the scan."""
    first = F.col(order_by[0])
    row = F.struct(*[F.col(c) for c in order_by])
    end = F.struct(*[v.alias(c) for v, c in zip(last, order_by)])
    return df.filter(((first <= last[0]) | first.isNull() | last[0].isNull()) & (row <= end))


def first_rows(df: DataFrame, order_by: list[str], n: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The first ``n`` rows in order, as a filter on the table.

    The last row to keep is found on the ordering columns alone: for few rows by a top-k, whose partial results end
    in one task and therefore must be narrow, for many by slices.
    """
    if n <= FEW_ROWS:
        top = df.select(*order_by).orderBy(*order_by).limit(n).select(*_as_text(order_by)).collect()
        if len(top) < n or n == 0:
            return df.limit(0) if n == 0 else df
        last = [typed_literal(v, df.schema[c].dataType) for v, c in zip(top[-1], order_by)]
    else:
        found = rows_at(df, order_by, [n - 1], rows_per_slice)
        if not found:
            return df
        last = found[n - 1]
    return up_to(df, order_by, last)


def slice_offsets(tagged: DataFrame, slices: Slices) -> list[int]:
    """Rows before each slice (one number per slice)."""
    found = {r[0]: r[1] for r in tagged.groupBy(SLICE).count().collect()}
    offsets, before = [], 0
    for i in range(slices.count):
        offsets.append(before)
        before += found.get(i, 0)
    return offsets + [before]


def global_ordinal(
    df: DataFrame, order_by: list[str], out: str = "ordinal", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Exact 0-based position of each row in ``order_by`` order: one shuffle, by slice."""
    if any("." in c or "`" in c for c in df.columns):
        short = {c: f"_c{i}" for i, c in enumerate(df.columns)}
        return global_ordinal(df.toDF(*short.values()), [short[c] for c in order_by], out, rows_per_slice).toDF(*short, out)
    slices = fit_slices(df, order_by, rows_per_slice, _parallelism(df))
    position = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order_by)).cast("long") - 1
    if slices.bounds:
        offsets = slice_offsets(slices.tag(df), slices)
        position = position + F.get(literal_array(offsets, T.LongType()), F.col(SLICE))
    return slices.place(df).withColumn(out, position).drop(SLICE)


def rows_at(
    df: DataFrame, order_by: list[str], positions: list[int], rows_per_slice: int = ROWS_PER_SLICE
) -> dict[int, list[Column]]:
    """The ordering columns, as literals, of the rows at the given 0-based positions.

    Only the slices holding a position are sorted, so no full sort and no wide shuffle takes place.
    """
    slices = fit_slices(df, order_by, rows_per_slice, _parallelism(df))
    tagged = slices.tag(df.select(*order_by))
    offsets = slice_offsets(tagged, slices)
    homes = {p: max(i for i in range(slices.count) if offsets[i] <= p) for p in positions if 0 <= p < offsets[-1]}
    if not homes:
        return {}
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order_by)) - 1
    at = F.get(literal_array(offsets, T.LongType()), F.col(SLICE)) + local
    rows = (
        tagged.filter(F.col(SLICE).isin(sorted(set(homes.values()))))
        .withColumn("_at", at)
        .filter(F.col("_at").isin(sorted(homes)))
        .select("_at", *_as_text(order_by))
        .collect()
    )
    return {r["_at"]: [typed_literal(r[c], df.schema[c].dataType) for c in order_by] for r in rows}


def _crossing(tagged: DataFrame, slices: Slices, keys: list[str]) -> DataFrame:
    """Rows whose key goes on into the next slice.

    Found by a join with one row per bound: a condition on the slice would be pushed below its expression, which then is worked out
    several times per row, each time in proportion to the number of bounds.
    """
    if not keys:
        return tagged.filter(F.col(SLICE) < len(slices.bounds))
    at = [slices.order_by.index(k) for k in keys]
    names = [f"_next_{i}" for i in range(len(keys))]
    rows = [(i, *[b[j] for j in at]) for i, b in enumerate(slices.bounds)]
    fields = ", ".join(["_at int", *[f"{n} string" for n in names]])
    following = tagged.sparkSession.createDataFrame(rows, fields).select(
        "_at", *[F.col(n).cast(slices.types[j]).alias(n) for n, j in zip(names, at, strict=True)]
    )
    match = [F.col(SLICE).eqNullSafe(F.col("_at"))] + [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return tagged.join(F.broadcast(following), all_of(match), "left_semi")


def forward_fill(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    partition_by: list[str] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Replace nulls by the last non-null value before them, overall or within ``partition_by`` keys.

    One shuffle of the table. The value carried into a slice is found from one aggregated row per slice.
    """
    if any("." in c or "`" in c for c in df.columns):
        short = {c: f"_c{i}" for i, c in enumerate(df.columns)}
        fill, order, keys = ([short[c] for c in cs or []] for cs in (columns, order_by, partition_by))
        return forward_fill(df.toDF(*short.values()), fill, order, keys, rows_per_slice).toDF(*short)
    keys = list(partition_by or [])
    order = keys + [c for c in order_by if c not in keys]
    slices = fit_slices(df, order, rows_per_slice, 1 if keys else _parallelism(df), max(len(keys), 1))
    local = Window.partitionBy(SLICE, *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    names = df.columns
    filled = slices.place(df).withColumns({c: F.last(c, ignorenulls=True).over(local) for c in columns})
    if not slices.bounds:
        return filled.select(*names)
    when_set = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_carry_{i}") for i, c in enumerate(columns)
    ]
    last_seen = _crossing(slices.tag(df), slices, keys).groupBy(SLICE, *keys).agg(*when_set)
    upto = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    # one row per slice at most, so the broadcast below is bounded by MAX_SLICES
    carry = last_seen.select(
        (F.col(SLICE) + 1).alias("_into"),
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.last(f"_carry_{i}", ignorenulls=True).over(upto).alias(f"_carry_{i}") for i in range(len(columns))],
    )
    if not keys:
        # a slice may hold no row at all: give each slice the carry of the nearest earlier one
        every = df.sparkSession.range(1, slices.count).select(F.col("id").cast("int").alias("_into"))
        onward = Window.orderBy("_into").rowsBetween(Window.unboundedPreceding, 0)
        carry = every.join(carry, "_into", "left").select(
            "_into",
            *[F.last(f"_carry_{i}", ignorenulls=True).over(onward).alias(f"_carry_{i}") for i in range(len(columns))],
        )
    match = all_of(
        [F.col(SLICE) == F.col("_into")] + [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    )
    joined = filled.join(F.broadcast(carry), match, "left")
    replaced = {c: F.coalesce(F.col(c), F.col(f"_carry_{i}")) for i, c in enumerate(columns)}
    return joined.withColumns(replaced).select(*names)


def sorted_columns(
    df: DataFrame, columns: list[str], order_by: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> dict[str, bool]:
    """For each column: do its non-null values never fall in ``order_by`` order? One narrow shuffle."""
    if not columns:
        return {}
    slices = fit_slices(df, order_by, rows_per_slice, _parallelism(df))
    tagged = slices.place(df.select(*dict.fromkeys(order_by + columns)))
    seen = Window.partitionBy(SLICE).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    checked = tagged.select(
        SLICE,
        *columns,
        *[(F.col(c) < F.last(c, ignorenulls=True).over(seen)).alias(f"_fall_{i}") for i, c in enumerate(columns)],
    )
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [
            F.max(F.coalesce(F.col(f"_fall_{i}"), F.lit(False))).alias(f"_fall_{i}"),
            F.min(c).alias(f"_low_{i}"),
            F.max(c).alias(f"_high_{i}"),
        ]
    per_slice = checked.groupBy(SLICE).agg(*aggregates)
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    joined = per_slice.select(
        *[
            (
                F.col(f"_fall_{i}")
                | F.coalesce(F.col(f"_low_{i}") < F.max(f"_high_{i}").over(earlier), F.lit(False))
            ).alias(f"_bad_{i}")
            for i in range(len(columns))
        ]
    )
    row = joined.agg(*[F.max(f"_bad_{i}") for i in range(len(columns))]).first()
    return {c: not row[i] for i, c in enumerate(columns)}


def preceding_rows(
    tagged: DataFrame, slices: Slices, keys: list[str], order_by: list[str], carry: list[str], depth: int
) -> DataFrame:
    """For each slice, the last ``depth`` rows of its first key that lie in earlier slices.

    At most ``depth`` rows per slice; they complete row-based frames that reach back over a slice bound.
    """
    needed = list(dict.fromkeys(keys + order_by + carry))
    within = Window.partitionBy(SLICE, *keys).orderBy(*[F.col(c).desc() for c in order_by])
    tails = (
        _crossing(tagged, slices, keys)
        .select(SLICE, *needed)
        .withColumn("_back", F.row_number().over(within))
        .filter(F.col("_back") <= depth)
    )
    reach = Window.partitionBy(*keys).orderBy(SLICE, *order_by).rowsBetween(-(depth - 1), 0)
    return (
        tails.withColumn("_rows", F.collect_list(F.struct(*needed)).over(reach))
        .filter(F.col("_back") == 1)
        .select((F.col(SLICE) + 1).alias(SLICE), F.inline("_rows"))
    )
