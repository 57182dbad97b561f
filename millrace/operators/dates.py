"""Date and Unix time detection on text and number columns.

Detection looks at all values, first at their forms, then, for formats that can still fit, at dates; parsing is a projection
over the table. A column takes the first format that parses more than 90 % of its non-null values. ``sample=n`` decides on
the first ``n`` non-null values in ``order_by`` order instead, for callers that ask for it.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product, zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fixed_values as fixed
from millrace.functions.cells import named, parsed_date
from millrace.plans.ordered import first_rows

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# seconds between which Unix times are dates from year 1 to year 9999
_DATE_SECONDS = (-62135596800, 253402300800)


def first_values(df: DataFrame, columns: list[str], order_by: list[str], n: int) -> dict[str, list]:
    """The first ``n`` non-null values of each column, at most ``n`` per column on the driver.

    One scan serves all columns that are not mostly null at the start; the rest take their own.
    """
    if not columns:
        return {}
    values = {c: f"_v{i}" for i, c in enumerate(columns)}
    staged = df.select(*[named(c) for c in order_by], *[named(c).alias(v) for c, v in values.items()])
    rows = first_rows(staged, order_by, 2 * n).orderBy(*order_by).select(*values.values()).collect()
    result = {}
    for c, v in values.items():
        result[c] = [r[v] for r in rows if r[v] is not None][:n]
        if len(result[c]) < n and len(rows) == 2 * n:
            filled = staged.select(*order_by, v).filter(F.col(v).isNotNull())
            result[c] = [r[0] for r in first_rows(filled, order_by, n).orderBy(*order_by).select(v).collect()]
    return result


_MONTH, _DAY = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
_SHAPES = {
    "yyyyMMdd": f"[0-9]{{4}}{_MONTH}{_DAY}", "yyyy": "[0-9]{4}", "MMM": "[A-Za-z]{3}", "M": _MONTH, "d": _DAY,
    "H": "[0-9]{1,2}", "m": "[0-9]{1,2}", "s": "[0-9]{1,2}",
}


# Forms of the parts of a date, digits as 9 and letters as a.
_FORMS = {
    "yyyyMMdd": ("99999999", "9999999", "999999"), "yyyy": ("9999",), "MMM": ("aaa",), "M": ("9", "99"), "d": ("9", "99"),
    "H": ("9", "99"), "m": ("9", "99"), "s": ("9", "99"),
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _forms(pattern: str) -> list[str]:
    """All forms of the texts that a date pattern reads."""
    parts = [_FORMS.get(p, (p,)) for p in re.findall("[A-Za-z]+|[^A-Za-z]+", pattern)]
    return ["".join(chosen) for chosen in product(*parts)]


_DATE_FORMS = sorted({form for _, pattern in fixed.DATE_FORMATS for form in _forms(pattern)})
_LONGEST = max(map(len, _DATE_FORMS))


def cell_form(value: Column) -> Column:
    """A short text with its digits as 9 and its letters as a; null for texts longer than any date."""
    plain = F.translate(value, "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS))
    return F.when(F.char_length(value) <= _LONGEST, plain)


def _shape(pattern: str) -> str:
    """What text in a date pattern looks like: parsing text that does not fit costs an exception per value."""
    return "^" + "".join(_SHAPES.get(p) or re.escape(p) for p in re.findall("[A-Za-z]+|[^A-Za-z]+", pattern)) + "$"


def _parsed(value: Column, form: Column, fmt: str, pattern: str) -> Column:
    """A value as date of the format, or null. Its form rules out most formats without matching them."""
    return F.when(form.isin(_forms(pattern)) & value.rlike(_shape(pattern)), parsed_date(value, fmt))


def _fitting(cells: DataFrame, threshold: float) -> dict[str, list[str]]:
    """For each column of text, the formats that more than ``threshold`` of its values are dates of.

    A first scan counts the forms of dates, each cell rewritten once: values of a format are at most those of its forms. A second one parses
    only the columns and formats that can still fit, so that its generated code is short enough to be compiled.
    """
    forms = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), cell_form(F.col(c)).alias("form")) for c in cells.columns])
    date_form = F.when(F.col("form").isin(_DATE_FORMS), F.col("form")).alias("form")
    counts = cells.select(F.inline(forms)).filter("value is not null").groupBy("column", date_form).count()
    filled, of_form = Counter(), Counter()
    for column, form, count in counts.collect():  # a column has no more forms than dates have
        filled[column] += count
        of_form[column, form] = count
    open_ = [
        (c, fmt, pattern)
        for c in cells.columns
        for fmt, pattern in fixed.DATE_FORMATS
        if sum(of_form[c, form] for form in _forms(pattern)) > threshold * filled[c]
    ]
    fits = {c: [] for c in cells.columns}
    if open_:
        used = list(dict.fromkeys(c for c, _, _ in open_))
        staged = cells.select(*used, *[cell_form(F.col(c)).alias(f"form_{c}") for c in used])
        seen = staged.agg(*[F.count(_parsed(F.col(c), F.col(f"form_{c}"), fmt, pattern)) for c, fmt, pattern in open_]).first()
        for (c, fmt, _), count in zip(open_, seen, strict=True):
            if count > threshold * filled[c]:
                fits[c].append(fmt)
    return fits


def detect_date_formats(
    df: DataFrame,
    order_by: list[str] | None = None,
    columns: list[str] | None = None,
    sample: int | None = None,
    threshold: float = fixed.DATE_THRESHOLD,
) -> DataFrame:
    """(column, format) for the string columns; format is null for columns that hold no dates.

    Two scans serve all columns and formats. ``order_by`` is only used with ``sample``.
    """
    spark = df.sparkSession
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    names = [c for c in columns if c in strings] if columns is not None else strings
    picked = {}
    if names:
        if sample is None:
            cells = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])
        else:
            firsts = first_values(df, names, order_by, sample)
            fields = ", ".join(f"c{i} string" for i in range(len(names)))
            cells = spark.createDataFrame(list(zip_longest(*[firsts[c] for c in names])), fields)
        fits = _fitting(cells, threshold)
        picked = {c: next(iter(fits[f"c{i}"]), None) for i, c in enumerate(names)}
    return spark.createDataFrame([(c, picked[c]) for c in names], "`column` string, format string").coalesce(1)


def date_formats(df: DataFrame, order_by: list[str] | None = None, **options) -> dict[str, str]:
    """Detected formats by column, date columns only."""
    found = detect_date_formats(df, order_by, **options).collect()
    return {r["column"]: r["format"] for r in found if r["format"] is not None}


def date_columns(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """(column, is_date): of a date type already, or text with a detected format."""
    detected = date_formats(df, order_by)
    rows = [(f.name, isinstance(f.dataType, _DATE_TYPES) or f.name in detected) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "`column` string, is_date boolean").coalesce(1)


def parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Text columns to dates by format; values that do not parse become null. Columns of a date type stay."""
    parsed = {
        c: parsed_date(named(c), fmt)
        for c, fmt in formats.items()
        if isinstance(df.schema[c].dataType, T.StringType)
    }
    return df.withColumns(parsed) if parsed else df


def auto_parse_dates(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    return parse_dates(df, date_formats(df, order_by))


def _unix_candidates(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType))]


def _inside(value: Column) -> Column:
    low, high = fixed.UNIX_SECONDS_RANGE
    return value.between(low, high) | value.between(low * 1000, high * 1000)


def detect_unix_ts(df: DataFrame, order_by: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """(column, is_unix): there are values, and each lies in the plausible range, in seconds or in milliseconds."""
    spark = df.sparkSession
    names = _unix_candidates(df)
    rows = []
    if names and sample is None:
        values = [named(c) for c in names]
        counts = [F.count(v).alias(f"n{i}") for i, v in enumerate(values)]
        inside = [F.count_if(_inside(v)).alias(f"in{i}") for i, v in enumerate(values)]
        seen = df.agg(*counts, *inside).first()
        rows = [(c, seen[f"n{i}"] > 0 and seen[f"n{i}"] == seen[f"in{i}"]) for i, c in enumerate(names)]
    elif names:
        low, high = fixed.UNIX_SECONDS_RANGE
        for c, values in first_values(df, names, order_by, sample).items():
            rows.append((c, bool(values) and all(low <= v <= high or low * 1000 <= v <= high * 1000 for v in values)))
    return spark.createDataFrame(rows, "`column` string, is_unix boolean").coalesce(1)


def parse_unix_ts(df: DataFrame, columns: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Unix time to date; values of more than ten digits count in milliseconds, each row by itself.

    Times before year 1 or after year 9999 become null. ``order_by`` has no effect.
    """
    low, high = _DATE_SECONDS
    parsed = {}
    for c in columns:
        value = named(c)
        whole = F.floor(value).cast("long")
        millis = F.when(value < high * 1000, F.timestamp_millis(whole))
        seconds = F.when(value >= low, F.timestamp_seconds(whole))
        parsed[c] = F.when(value > fixed.UNIX_MILLIS_ABOVE, millis).otherwise(seconds).cast("date")
    return df.withColumns(parsed) if parsed else df
