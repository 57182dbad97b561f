"""Column profiling: one row per column with type-specific statistics.

Every statistic is computed over the whole table for all columns together. Only the finished per-column numbers reach
the driver (one row per column), where they become the profile frame.

Choices: columns are classified by Spark type; the distinct count of a non-string column counts null as a value while
that of a string column does not; top values are ordered by count, then value; an all-null string column is no target
candidate; NaN is a value, but is left out of ranks, fences and moments.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fixed_values as fixed
from millrace.plans.hash_order import smallest_hashes
from millrace.plans.order_stats import quartiles_and_median
from millrace.plans.ordered import sorted_columns

PROFILE_COLUMNS = {
    "column": "string", "position": "int", "dtype": "string", "type": "string", "null_count": "bigint",
    "null_percentage": "double", "unique_count": "bigint", "domain_hint": "string", "min": "double", "max": "double",
    "mean": "double", "median": "double", "std": "double", "q1": "double", "q3": "double", "iqr": "double",
    "lower": "double", "upper": "double", "outlier_count": "bigint", "outlier_percentage": "double",
    "skewness": "double", "is_skewed": "boolean", "is_high_cardinality": "boolean", "cardinality_ratio": "double",
    "top_values": "array<struct<value:string,count:bigint>>", "min_date": "string", "max_date": "string",
    "is_monotonic": "boolean", "all_null": "boolean",
}


def _schema(names) -> str:
    return ", ".join(f"`{n}` {PROFILE_COLUMNS[n]}" for n in names)


def column_kind(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return None


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema if column_kind(f.dataType) == kind]


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def _usable(df: DataFrame, column: str) -> Column:
    """The column as double without NaN."""
    value = _name(column).cast("double")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def _long_form(df: DataFrame, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation over the whole table, its results turned into one row per column."""
    names = list(parts)
    stats = list(next(iter(parts.values())))
    one = df.agg(*[parts[c][s].alias(f"{s}_{i}") for i, c in enumerate(names) for s in stats])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{s}_{i}").alias(s) for s in stats]) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def dataset_info(df: DataFrame, sample_size: int = fixed.PROFILE_SAMPLE) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        (F.col("total_rows") > sample_size).alias("sampled"),
        F.least(F.col("total_rows"), F.lit(sample_size)).alias("sample_size"),
    )


def profile_sample(df: DataFrame, key: list[str], n: int = fixed.PROFILE_SAMPLE, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by seeded hash of a unique key. A filter, not a shuffle."""
    return smallest_hashes(df, key, n, seed)


def _percent(part: int, whole: int) -> float:
    """Percentage to two digits, rounded as a binary double (ties by its exact value)."""
    return round(part / whole * 100, 2) if whole else 0.0


def null_counts(df: DataFrame) -> DataFrame:
    nulls, total = null_counts_and_rows(df)
    rows = [(c, n, _percent(n, total)) for c, n in nulls.items()]
    return df.sparkSession.createDataFrame(rows, _schema(["column", "null_count", "null_percentage"])).coalesce(1)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, count) for all columns in one pass; partial counts combine before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), _name(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count("*").alias("count"))


LONG_TEXT = 64  # bytes; longer values are grouped by digest, so that texts do not travel


def _digest(value: Column) -> Column:
    """Short values as they are, long ones as a digest that no short value can equal."""
    long = F.octet_length(value) > LONG_TEXT
    return F.when(long, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)


MOST_POSSIBLE = 4096  # values per column whose texts are looked up to order them


def _first_ranked(counted: DataFrame, order: list, k: int) -> DataFrame:
    best = Window.partitionBy("column").orderBy(*order)
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _possible(keyed: DataFrame, k: int) -> DataFrame:
    """(column, digest, count) of the values that can be among the first ``k`` by count and text, at most ``MOST_POSSIBLE`` per column.

    Values are counted by digest and beginning. The ``k``-th by these two is found first (a limit of k rows per column and task), then
    everything not behind it is kept by comparison. Where that is too much, as many values begin alike, longer beginnings
    tell more of them apart, in the end the whole texts.
    """
    length = 16
    while True:
        counted = keyed.groupBy("column", "digest", F.substring("value", 1, length).alias("start")).agg(F.count("*").alias("count"))
        last = _first_ranked(counted, [F.desc("count"), "start"], k).filter(F.col("rank") == k)
        behind, open_ = F.lit(False), F.lit(False)
        for r in last.select("column", "count", "start").collect():  # one row per column
            here = F.col("column") == r["column"]
            behind = behind | here & ((F.col("count") < r["count"]) | (F.col("count") == r["count"]) & (F.col("start") > r["start"]))
            open_ = open_ | here & (F.col("count") == r["count"]) & (F.col("start") == r["start"]) & (F.length("start") >= length)
        possible = counted.filter(~behind)
        most = possible.groupBy("column").agg(F.count("*").alias("n"), F.bool_or(open_).alias("cut")).collect()
        if not any(r["n"] > MOST_POSSIBLE and r["cut"] for r in most):
            return possible.select("column", "digest", "count")
        length *= 4


def top_values(df: DataFrame, columns: list[str], k: int = fixed.TOP_VALUES) -> DataFrame:
    """The k most frequent non-null values per column, by count, then value. The rank limit is applied before the shuffle as well.

    Columns with long texts are counted by digest and the beginning of the value; the texts of the few values that can be among the
    first k are then looked up. No task ranks more than k rows per column and task before it, however many values tie.
    """
    order = [F.desc("count"), "value"]
    lengths = df.agg(*[F.max(F.octet_length(_name(c).cast("string"))) for c in columns]).first()
    short = [c for c, n in zip(columns, lengths) if (n or 0) <= LONG_TEXT]
    long = [c for c in columns if c not in short]
    parts = []
    if short:
        counted = value_counts(df, short).filter(F.col("value").isNotNull())
        parts.append(_first_ranked(counted, order, k))
    if long:
        cells = [F.struct(F.lit(c).alias("column"), _name(c).cast("string").alias("value")) for c in long]
        values = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
        keyed = values.withColumn("digest", _digest(F.col("value")))
        possible = F.broadcast(_possible(keyed, k))  # at most MOST_POSSIBLE rows per column
        texts = keyed.join(possible, ["column", "digest"]).groupBy("column", "digest", "count").agg(F.min("value").alias("value"))
        parts.append(_first_ranked(texts.select("column", "value", "count"), order, k))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _group_key(f: T.StructField) -> Column:
    if isinstance(f.dataType, T.StringType):
        return _digest(_name(f.name))
    if isinstance(f.dataType, (T.MapType, T.VariantType)):
        return _digest(F.to_json(_name(f.name)))
    return _name(f.name)


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, unique_count with null as a value, distinct_values without it).

    Exact counts group (column, value) pairs, one pass per column type, so no value set is held by one task.
    """
    if not exact:
        parts = {
            c: {"distinct_values": F.approx_count_distinct(_name(c)), "nulls": F.count_if(_name(c).isNull())}
            for c in df.columns
        }
        has_null = F.when(F.col("nulls") > 0, 1).otherwise(0)
        return _long_form(df, parts).select(
            "column", (F.col("distinct_values") + has_null).alias("unique_count"), "distinct_values"
        )
    families = defaultdict(list)
    for f in df.schema:
        families[f.dataType.simpleString()].append(f)
    result = None
    for fields in families.values():
        cells = [F.struct(F.lit(f.name).alias("column"), _group_key(f).alias("value")) for f in fields]
        counted = (
            df.select(F.inline(F.array(*cells)))
            .groupBy("column", "value")
            .agg(F.lit(1).alias("one"))
            .groupBy("column")
            .agg(F.count("*").alias("unique_count"), F.count("value").alias("distinct_values"))
        )
        result = counted if result is None else result.unionAll(counted)
    return result


def moments(df: DataFrame) -> DataFrame:
    """min, max, mean and sample deviation (0 for a single value) of the numeric columns; one pass."""
    parts = {}
    for c in columns_of(df, "numeric"):
        v = _usable(df, c)
        parts[c] = {
            "values": F.count(v),
            "min": F.min(v),
            "max": F.max(v),
            "mean": F.avg(v),
            "std": F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, 0.0)),
        }
    return _long_form(df, parts)


def numeric_profile(df: DataFrame) -> DataFrame:
    """Numeric statistics incl. nearest quartiles, fences, outliers and the mean-median skew measure."""
    stats = _numeric_stats(df)
    names = ["column", "min", "max", "mean", "median", "std", "q1", "q3", "iqr", "lower", "upper"]
    names += ["outlier_count", "outlier_percentage", "skewness", "is_skewed"]
    rows = [tuple({"column": c, **s}.get(n) for n in names) for c, s in stats.items()]
    return df.sparkSession.createDataFrame(rows, _schema(names))


def outlier_counts(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Values strictly outside the fences, all columns in one pass."""
    parts = {}
    for c, (lower, upper) in fences.items():
        v = _usable(df, c)
        parts[c] = {"outlier_count": F.count_if((v < lower) | (v > upper)), "values": F.count(v)}
    return _long_form(df, parts)


def _numeric_stats(df: DataFrame) -> dict[str, dict]:
    names = columns_of(df, "numeric")
    if not names:
        return {}
    stats = {r["column"]: r.asDict() for r in moments(df).collect()}
    filled = {c: s for c, s in stats.items() if s["values"] > 0}
    plain = df.select(*[_usable(df, c).alias(c) for c in filled])
    ranked = quartiles_and_median(
        plain, {c: s["values"] for c, s in filled.items()}, {c: (s["min"], s["max"]) for c, s in filled.items()}
    )
    fences = {}
    for c, (q1, median, q3) in ranked.items():
        iqr = q3 - q1
        fences[c] = (q1 - fixed.TUKEY * iqr, q3 + fixed.TUKEY * iqr)
        stats[c].update(q1=q1, median=median, q3=q3, iqr=iqr, lower=fences[c][0], upper=fences[c][1])
    if fences:
        for r in outlier_counts(plain, fences).collect():
            s = stats[r["column"]]
            s["outlier_count"] = r["outlier_count"]
            s["outlier_percentage"] = _percent(r["outlier_count"], s["values"])
            skew = (s["mean"] - s["median"]) / s["std"] if s["std"] > 0 else 0.0
            s["skewness"], s["is_skewed"] = round(skew, 3), abs(skew) > fixed.SKEW_LIMIT
    return stats


def categorical_profile(df: DataFrame) -> DataFrame:
    """Distinct non-null values, high-cardinality flag and cardinality ratio of the string columns."""
    texts = df.select(*[_name(c) for c in columns_of(df, "categorical")])
    nulls, total = null_counts_and_rows(texts)
    distinct = {r["column"]: r["distinct_values"] for r in distinct_counts(texts).collect()}
    rows = [(c, distinct[c], *_cardinality(distinct[c], total - n)) for c, n in nulls.items() if n < total]
    names = ["column", "unique_count", "is_high_cardinality", "cardinality_ratio"]
    return df.sparkSession.createDataFrame(rows, _schema(names)).coalesce(1)


def _cardinality(distinct: int, values: int) -> tuple[bool, float]:
    return distinct > values * fixed.HIGH_CARDINALITY, round(distinct / values, 3)


def temporal_profile(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Earliest and latest value as text, and whether the column never falls in ``order_by`` order."""
    names = columns_of(df, "temporal")
    parts = {
        c: {"min_date": F.min(_name(c)).cast("string"), "max_date": F.max(_name(c)).cast("string")} for c in names
    }
    sorted_ = sorted_columns(df, names, order_by) if order_by else {}
    known = F.create_map(*[F.lit(x) for c, v in sorted_.items() for x in (c, v)]) if sorted_ else None
    monotone = F.element_at(known, F.col("column")) if sorted_ else F.lit(None).cast("boolean")
    return _long_form(df, parts).withColumn("is_monotonic", monotone)


def domain_hint(name: Column) -> Column:
    """Hint from a column name: substring tests, first group that hits wins."""
    lowered = F.lower(name)
    result = F.lit(None).cast("string")
    for hint, marks in reversed(fixed.DOMAIN_HINTS):
        hit = lowered.contains(marks[0])
        for m in marks[1:]:
            hit = hit | lowered.contains(m)
        result = F.when(hit, F.lit(hint)).otherwise(result)
    return result


def column_profile(df: DataFrame, order_by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """The full profile, one row per column (``PROFILE_COLUMNS``).

    ``order_by`` enables the monotone test of temporal columns. ``exact=False`` estimates distinct counts.
    The independent parts run as concurrent jobs.
    """
    strings, temporal = columns_of(df, "categorical"), columns_of(df, "temporal")
    with ThreadPoolExecutor(5) as jobs:
        nulls_ = jobs.submit(lambda: null_counts_and_rows(df))
        numeric_ = jobs.submit(_numeric_stats, df)
        distinct_ = jobs.submit(lambda: {r["column"]: r for r in distinct_counts(df, exact).collect()})
        top_ = jobs.submit(lambda: top_values(df, strings).collect() if strings else [])
        temporal_ = jobs.submit(
            lambda: {r["column"]: r for r in temporal_profile(df, order_by).collect()} if temporal else {}
        )
        hints_ = {r["column"]: r["hint"] for r in _hints(df)}
        nulls, total = nulls_.result()
        numeric, distinct, times = numeric_.result(), distinct_.result(), temporal_.result()
        tops = defaultdict(list)
        for r in sorted(top_.result(), key=lambda r: r["rank"]):
            tops[r["column"]].append((r["value"], r["count"]))

    rows = []
    for position, f in enumerate(df.schema):
        c, kind = f.name, column_kind(f.dataType)
        present = total - nulls[c]
        seen = distinct.get(c)  # no row at all for an empty table
        row = {
            "column": c,
            "position": position,
            "dtype": f.dataType.simpleString(),
            "type": kind,
            "null_count": nulls[c],
            "null_percentage": _percent(nulls[c], total),
            "unique_count": seen["unique_count"] if seen else 0,
            "domain_hint": hints_[c],
            "all_null": present == 0,
        }
        if kind == "numeric" and present:
            row.update({k: v for k, v in numeric[c].items() if k != "values"})
        elif kind == "categorical" and present:
            row["unique_count"] = seen["distinct_values"]
            row["is_high_cardinality"], row["cardinality_ratio"] = _cardinality(seen["distinct_values"], present)
            row["top_values"] = tops[c]
        elif kind == "temporal" and present:
            row.update({k: times[c][k] for k in ("min_date", "max_date", "is_monotonic")})
        rows.append(tuple(row.get(n) for n in PROFILE_COLUMNS))
    return df.sparkSession.createDataFrame(rows, _schema(PROFILE_COLUMNS)).coalesce(1)


def null_counts_and_rows(df: DataFrame) -> tuple[dict[str, int], int]:
    row = df.agg(F.count("*"), *[F.count_if(_name(c).isNull()) for c in df.columns]).first()
    return dict(zip(df.columns, row[1:])), row[0]


def _hints(df: DataFrame) -> list:
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "`column` string")
    return names.select("column", domain_hint(F.col("column")).alias("hint")).collect()


def profile_insights(profile: DataFrame) -> DataFrame:
    """One row about the whole table, from its profile (one row per column)."""
    candidate = (
        (F.col("type") == "categorical")
        & ~F.col("all_null")
        & ~F.coalesce(F.col("is_high_cardinality"), F.lit(False))
        & (F.col("unique_count") < fixed.TARGET_DISTINCT)
    )

    def listed(condition: Column) -> Column:
        found = F.collect_list(F.when(condition, F.struct("position", "column")))
        return F.transform(F.array_sort(found), lambda x: x["column"])

    return profile.agg(
        F.count("*").alias("total_columns"),
        F.count_if(F.col("type") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("type") == "categorical").alias("categorical_columns"),
        F.count_if(F.col("type") == "temporal").alias("temporal_columns"),
        listed(candidate).alias("target_candidates"),
        listed(F.col("null_percentage") > fixed.HIGH_MISSING_PCT).alias("high_missing_columns"),
        (F.count_if(F.col("type") == "temporal") > 0).alias("has_temporal"),
    )


def profile_rows(profile: DataFrame) -> dict[str, dict]:
    """A profile as plain records by column name (one per column), in column order."""
    return {r["column"]: r.asDict() for r in sorted(profile.collect(), key=lambda r: r["position"])}
