"""Cleaning: coercion, typing, names, outliers, missing values, and whole recipes.

Choices: rows dropped as outliers include those with a null in a fenced column; fences of columns that no longer
exist are skipped; integer columns clipped to fractional fences or filled with a mean become doubles, decimal ones
are clipped to fences of their scale; "mode" in a recipe means forward fill in row order, the true mode is
``impute_mode``; a recipe uses the profile taken before preprocessing unless ``reprofile``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fixed_values as fixed
from millrace.functions.cells import as_number, is_filled, is_number, named, undecorated, without_commas
from millrace.operators.dates import date_formats, parse_dates
from millrace.operators.profile import column_kind, column_profile, profile_rows, top_values
from millrace.operators.recipe import Recipe
from millrace.plans.order_stats import medians
from millrace.plans.ordered import forward_fill

TARGET_TYPES = {
    "Int64": "bigint", "Int32": "int", "Float64": "double", "Float32": "float", "Utf8": "string", "Date": "date",
    "Datetime": "timestamp_ntz",
}
_NUMBER_TARGETS = ("Int64", "Int32", "Float64", "Float32")


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


# --- mixed types ---


def coerce_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, filled, numeric, ratio) of the string columns: how many cleaned values read as numbers. One pass."""
    names = _strings(df) if columns is None else columns
    aggregates = []
    for i, c in enumerate(names):
        bare = F.col(f"t{i}")
        aggregates += [F.count_if(is_filled(bare)).alias(f"f{i}"), F.count_if(is_number(bare)).alias(f"n{i}")]
    cleaned = df.select(*[undecorated(named(c)).alias(f"t{i}") for i, c in enumerate(names)])
    counts = cleaned.agg(*aggregates) if names else df.sparkSession.range(0)
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"n{i}").alias("numeric"))
        for i, c in enumerate(names)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "`column` string, filled bigint, numeric bigint, ratio double")
    ratio = F.when(F.col("filled") > 0, F.col("numeric") / F.col("filled"))
    return counts.select(F.inline(F.array(*rows))).withColumn("ratio", ratio)


def mixed_columns(df: DataFrame, threshold: float = fixed.COERCE_THRESHOLD) -> list[str]:
    return [r["column"] for r in coerce_ratios(df).filter(F.col("ratio") >= threshold).collect()]


def coerce_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles. Undecorated text is staged as columns of its own, so that it is made once."""
    if not columns:
        return df
    names = {c: f"_bare_{i}" for i, c in enumerate(columns)}
    staged = df.withColumns({n: undecorated(named(c)) for c, n in names.items()})
    return staged.withColumns({c: as_number(F.col(n)) for c, n in names.items()}).drop(*names.values())


def coerce_mixed(df: DataFrame, threshold: float = fixed.COERCE_THRESHOLD) -> DataFrame:
    """String columns of which enough values are numbers become doubles, other values null."""
    return coerce_columns(df, mixed_columns(df, threshold))


def smart_preprocess(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Dates first, then numbers, so that compact dates are not read as numbers."""
    return coerce_mixed(parse_dates(df, date_formats(df, order_by)))


# --- types and columns ---


def strip_commas(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: without_commas(named(c)) for c in columns if c in df.columns})


def convert_types(df: DataFrame, types: dict[str, str], on_error: str = "raise") -> DataFrame:
    """Cast to the seven target types; unknown targets are skipped. ``on_error="null"`` keeps going on bad values."""
    casts = {}
    for c, target in types.items():
        if target in TARGET_TYPES and c in df.columns:
            to = TARGET_TYPES[target]
            casts[c] = named(c).try_cast(to) if on_error == "null" else named(c).cast(to)
    return df.withColumns(casts) if casts else df


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def clean_header(name: str) -> str:
    name = name.strip(fixed.HEADER_ENDS)
    for mark in fixed.HEADER_INVISIBLE:
        name = name.replace(mark, "")
    return name.strip()


def _unique(names: list[str]) -> list[str]:
    taken, result = set(names), []
    for n in names:
        if n in result:
            k = 2
            while f"{n}_{k}" in taken:
                k += 1
            n = f"{n}_{k}"
            taken.add(n)
        result.append(n)
    return result


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip byte-order marks, zero-width characters and blanks from names; repeated names get ``_2``, ``_3`` ..."""
    return df.toDF(*_unique([clean_header(c) for c in df.columns]))


def snake_name(name: str) -> str:
    words = "".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in name.lower()).split()
    return "_".join(words)


def standardize_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by ``mapping`` if it covers every column, else to snake case."""
    if mapping and all(c in mapping for c in df.columns):
        return df.toDF(*[mapping[c] for c in df.columns])
    return df.toDF(*_unique([snake_name(c) for c in df.columns]))


# --- outliers ---


def _fences(df: DataFrame, profile: dict[str, dict]) -> dict[str, tuple[float, float]]:
    return {
        c: (s["lower"], s["upper"])
        for c, s in profile.items()
        if c in df.columns and s["type"] == "numeric" and (s["outlier_count"] or 0) > 0 and s["lower"] is not None
        and column_kind(df.schema[c].dataType) == "numeric"
    }


def _clipped(df: DataFrame, column: str, lower: float, upper: float) -> Column:
    """Values outside the fences moved to them, all others as they are.

    Fences take the column's type: in a decimal column they are rounded to its scale. An integer column with fractional fences
    becomes a double.
    """
    value, dtype = named(column), df.schema[column].dataType
    exact = isinstance(dtype, T.DecimalType) or isinstance(dtype, T.IntegralType) and lower.is_integer() and upper.is_integer()
    high, low = (F.lit(fence).try_cast(dtype) if exact else F.lit(fence) for fence in (upper, lower))
    # a fence beyond the type has nothing outside it, and its cast is null
    return F.when(value > high, high).when(value < low, low).otherwise(value)


def _within(fences: dict[str, tuple[float, float]]) -> Column:
    result = F.lit(True)
    for c, (lower, upper) in fences.items():
        result = result & (named(c) >= lower) & (named(c) <= upper)
    return result


def handle_outliers(df: DataFrame, strategy: str, profile: DataFrame | dict) -> DataFrame:
    """Clip to, or drop rows outside, the profile's fences of columns with outliers."""
    fences = _fences(df, profile if isinstance(profile, dict) else profile_rows(profile))
    if not fences or strategy == "keep":
        return df
    if strategy == "clip":
        return df.withColumns({c: _clipped(df, c, lower, upper) for c, (lower, upper) in fences.items()})
    if strategy == "drop":
        return df.filter(_within(fences))
    raise ValueError(f"unknown outlier strategy: {strategy}")


# --- missing values ---


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the column mean (doubles); one aggregation for all columns."""
    if not columns:
        return df
    means = df.agg(*[F.avg(named(c)).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.coalesce(named(c).cast("double"), F.lit(m)) for c, m in means.items() if m is not None})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the exact column median (doubles), found without gathering a column in one task."""
    if not columns:
        return df
    aggregates = []
    for c in columns:
        v = F.when(~F.isnan(named(c).cast("double")), named(c).cast("double"))
        aggregates += [F.count(v), F.min(v), F.max(v)]
    row = df.agg(*aggregates).first()
    plain = {f"_m{i}": c for i, c in enumerate(columns) if row[3 * i]}
    counts = {f"_m{i}": row[3 * i] for i in range(len(columns)) if row[3 * i]}
    extent = {f"_m{i}": (row[3 * i + 1], row[3 * i + 2]) for i in range(len(columns)) if row[3 * i]}
    values = df.select(*[named(c).alias(m) for m, c in plain.items()])
    found = {plain[m]: v for m, v in medians(values, counts, extent).items()} if counts else {}
    return df.withColumns({c: F.coalesce(named(c).cast("double"), F.lit(m)) for c, m in found.items()}) if found else df


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the most frequent value, the smallest (as text) among equally frequent ones."""
    found = {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()} if columns else {}
    filled = {c: F.coalesce(named(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in found.items()}
    return df.withColumns(filled) if filled else df


def handle_missing(
    df: DataFrame,
    strategy: str,
    profile: DataFrame | dict,
    order_by: list[str] | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Treat the columns the profile saw nulls in. ``drop_rows`` looks at all columns."""
    stats = profile if isinstance(profile, dict) else profile_rows(profile)
    gaps = [c for c, s in stats.items() if s["null_percentage"] > 0 and c in df.columns]
    if not gaps or strategy == "keep":
        return df
    numeric = [c for c in gaps if stats[c]["type"] == "numeric" and column_kind(df.schema[c].dataType) == "numeric"]
    if strategy == "drop_rows":
        return df.na.drop("any")
    if strategy == "mean":
        return impute_mean(df, numeric)
    if strategy == "median":
        return impute_median(df, numeric)
    if strategy == "mode":
        if not order_by:
            raise ValueError("forward fill needs order_by")
        return forward_fill(df, gaps, order_by, partition_by)
    raise ValueError(f"unknown missing-value strategy: {strategy}")


# --- recipes ---


@dataclass
class Audit:
    """What a recipe did.

    Row counts come from observations, known once the cleaned frame has been written or counted: ``frame`` of an
    observed recipe waits for that, so consume the frame first.
    """

    spark: SparkSession
    entries: list[tuple[str, str]] = field(default_factory=list)
    seen: dict[int, tuple[Observation, Observation]] = field(default_factory=dict)

    def note(self, action: str, detail: str) -> None:
        self.entries.append((action, detail))

    def frame(self) -> DataFrame:
        rows = []
        for step, (action, detail) in enumerate(self.entries, 1):
            before, after = self.seen.get(step, (None, None))
            rows.append((step, action, detail, before.get["rows"] if before else None, after.get["rows"] if after else None))
        return self.spark.createDataFrame(
            rows, "step int, action string, detail string, rows_before bigint, rows_after bigint"
        ).coalesce(1)


def _listed(names: list[str]) -> str:
    return ",".join(names)


def apply_recipe(
    df: DataFrame,
    recipe: Recipe,
    profile: DataFrame,
    order_by: list[str],
    dry_run: bool = False,
    reprofile: bool = False,
    observe: bool = False,
) -> tuple[DataFrame, Audit]:
    """Preprocess, drop columns, convert types, treat outliers, treat missing values.

    Returns the cleaned frame (lazy but for detection) and the audit. A dry run logs the recipe's steps and leaves
    the frame as preprocessed. ``observe`` counts rows around the steps that drop rows while the frame is consumed.
    """
    audit = Audit(df.sparkSession)
    formats = date_formats(df, order_by)
    if formats:
        df = parse_dates(df, formats)
        audit.note("AUTO_PARSE_DATES", _listed(list(formats)))
    mixed = mixed_columns(df)
    if mixed:
        df = coerce_columns(df, mixed)
        for c in mixed:
            audit.note("MIXED_TYPE", c)
    stats = profile_rows(column_profile(df, order_by) if reprofile else profile)

    if recipe.drop_columns:
        audit.note("DROP", _listed(recipe.drop_columns))
        df = df if dry_run else drop_columns(df, recipe.drop_columns)
    if recipe.type_conversions:
        audit.note("TYPE_CONVERSION", _listed([f"{c}:{t}" for c, t in recipe.type_conversions.items()]))
        if not dry_run:
            numbers = [c for c, t in recipe.type_conversions.items() if t in _NUMBER_TARGETS]
            df = convert_types(strip_commas(df, numbers), recipe.type_conversions)
    if recipe.outlier_strategy != "keep":
        audit.note("OUTLIERS", recipe.outlier_strategy)
        if not dry_run:
            df = _watched(df, audit, observe and recipe.outlier_strategy == "drop",
                          lambda d: handle_outliers(d, recipe.outlier_strategy, stats))
    if recipe.impute_strategy != "keep":
        audit.note("MISSING", recipe.impute_strategy)
        if not dry_run:
            df = _watched(df, audit, observe and recipe.impute_strategy == "drop_rows",
                          lambda d: handle_missing(d, recipe.impute_strategy, stats, order_by))
    return df, audit


def _watched(df: DataFrame, audit: Audit, watch: bool, step) -> DataFrame:
    if not watch:
        return step(df)
    before, after = Observation(), Observation()
    audit.seen[len(audit.entries)] = (before, after)
    counted = F.count(F.lit(1)).alias("rows")
    return step(df.observe(before, counted)).observe(after, counted)
