"""Licence detection over tables of texts. Projections only, so each also runs on a stream.

Choices: patterns are matched on text with "-" and "_" blanked, and keywords as plain substrings, which finds "mit"
inside other words; ``word_boundary`` avoids that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions import licenses as lic


def _hits(df: DataFrame, column: str, rules: lic.Rules, word_boundary: bool) -> DataFrame:
    """Pattern hit, and keyword hit where no pattern matched."""
    staged = lic.with_search_text(df, F.col(column))
    by_pattern = staged.withColumn("_pattern", lic.by_pattern(rules))
    keyword = F.when(F.col("_pattern").isNull(), lic.by_keyword(rules, word_boundary))
    return by_pattern.withColumn("_keyword", keyword)


def detect_license(
    df: DataFrame, column: str, rules: lic.Rules = fixed.LICENSES, word_boundary: bool = False
) -> DataFrame:
    """Add license_type, confidence, allows_commercial and source."""
    hits = _hits(df, column, rules, word_boundary)
    fields = lic.license_fields(F.col(column), F.col("_pattern"), F.col("_keyword"), rules)
    kept = [F.col(c) for c in df.columns if c not in fields]
    return hits.select(*kept, *[v.alias(n) for n, v in fields.items()])


def license_by_pattern(df: DataFrame, column: str, rules: lic.Rules = fixed.LICENSES) -> DataFrame:
    """Add license_type: the first licence with a matching pattern, or null."""
    staged = lic.with_search_text(df, F.col(column))
    return staged.withColumn("license_type", lic.by_pattern(rules)).drop(lic.LOWERED, lic.BLANKED)


def license_by_keyword(
    df: DataFrame, column: str, rules: lic.Rules = fixed.LICENSES, word_boundary: bool = False
) -> DataFrame:
    """Add license_type: the first licence with a keyword in the text, or null."""
    staged = lic.with_search_text(df, F.col(column))
    return staged.withColumn("license_type", lic.by_keyword(rules, word_boundary)).drop(lic.LOWERED, lic.BLANKED)


def license_summary(detected: DataFrame) -> DataFrame:
    """Texts per licence and source of the finding."""
    return detected.groupBy("license_type", "source").agg(F.count("*").alias("texts"))


def detect_license_json(df: DataFrame, column: str, **options) -> DataFrame:
    """Detection on JSON metadata: the licence field if there is one, else the whole text."""
    return detect_license(df.withColumn("_text", lic.text_of_json(F.col(column))), "_text", **options).drop("_text")
