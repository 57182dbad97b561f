"""Column expressions for single values: trimming, numbers, dates, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed

# Unicode white space, spelled out because Java's \s is ASCII only: as pattern, and as the characters themselves
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$|^(?i:nan)$"


def named(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result


def all_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(_BLANKS))


def undecorated(value: Column) -> Column:
    """Trimmed text without currency and grouping signs."""
    return F.translate(strip(value), fixed.NUMBER_DECORATION, "")


def is_filled(bare: Column) -> Column:
    """Whether undecorated text is no null token."""
    return ~bare.isin(fixed.NULL_TOKENS)


def is_number(bare: Column) -> Column:
    """Whether undecorated text spells a number; the pattern keeps out Java spellings such as ``10d``."""
    return bare.rlike(_NUMBER)


def as_number(bare: Column) -> Column:
    """Undecorated text to double, null for tokens and any other text. Give a staged column: it is used twice."""
    return F.when(is_number(bare), bare.try_cast("double"))


def without_commas(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit(","), F.lit(""))


def parsed_date(value: Column, fmt: str) -> Column:
    """Text to date by one of the known format strings; null where it does not parse, any time part dropped."""
    pattern = dict(fixed.DATE_FORMATS)[fmt]
    if "%H" in fmt:
        return F.try_to_timestamp(value, F.lit(pattern)).cast("date")
    return F.try_to_date(value, pattern)


def snake_case(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
