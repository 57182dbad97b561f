"""Licence recognition as column expressions; all are projections over whole texts.

Case is ignored by searching lower-case text with lower-case patterns: the regular expressions then need no case
folding, and each runs only on texts that hold all words of one of its alternatives, by plain substring tests.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.cells import SPACE, all_of, any_of

LOWERED, BLANKED = "_lowered", "_blanked"
_MENTION = r"(^|[^\p{L}\p{N}_])license([^\p{L}\p{N}_]|\z)"

Rules = list[tuple[str, list[str], list[str], bool]]


def with_search_text(df: DataFrame, text: Column) -> DataFrame:
    """Stage the two forms of a text that are searched, each computed once per row.

    The long s equals "s" when case is ignored, but lower-casing keeps it.
    """
    lowered = df.withColumn(LOWERED, F.replace(F.lower(text), F.lit("ſ"), F.lit("s")))
    blank = F.lit(" ")
    return lowered.withColumn(BLANKED, F.replace(F.replace(F.col(LOWERED), F.lit("-"), blank), F.lit("_"), blank))


def _regex(patterns: list[str]) -> str:
    """Alternatives in lower case, white space as Unicode defines it; "." stops at a line feed only."""
    return "(?d)" + "|".join(p.lower().replace(r"\s", SPACE) for p in patterns)


def _words(pattern: str) -> list[str]:
    """The words any match of a pattern holds: what is left of it without optional and variable parts."""
    fixed_part = re.sub(r"\\s\+|\\\.|\.\*|.\?", " ", pattern.lower())
    return sorted(set(re.findall(r"[a-z0-9]+", fixed_part)), key=lambda w: (-len(w), w))  # rare ones first


def _first(rules: Rules, test) -> Column:
    result = F.lit(None).cast("string")
    for rule in reversed(rules):
        result = F.when(test(rule), F.lit(rule[0])).otherwise(result)
    return result


def by_pattern(rules: Rules = fixed.LICENSES) -> Column:
    """Identifier of the first licence with a matching pattern, on staged text."""
    blanked = F.col(BLANKED)

    def hit(rule):
        possible = any_of([all_of([blanked.contains(w) for w in _words(p)]) for p in rule[1]])
        return possible & blanked.rlike(_regex(rule[1]))

    return _first(rules, hit)


def by_keyword(rules: Rules = fixed.LICENSES, word_boundary: bool = False) -> Column:
    """Identifier of the first licence with a keyword in the staged text; a plain substring unless ``word_boundary``."""
    lowered = F.col(LOWERED)

    def hit(rule):
        plain = any_of([lowered.contains(k) for k in rule[2]])
        if not word_boundary:
            return plain
        words = "|".join(re.escape(k) for k in rule[2])
        return plain & lowered.rlike(rf"(^|[^\p{{L}}\p{{N}}])({words})([^\p{{L}}\p{{N}}]|\z)")

    return _first(rules, hit)


def allows_commercial(license_type: Column, rules: Rules = fixed.LICENSES) -> Column:
    return license_type.isin([r[0] for r in rules if r[3]])


def license_fields(
    text: Column, pattern: Column, keyword: Column, rules: Rules = fixed.LICENSES
) -> dict[str, Column]:
    """Type, confidence, commercial flag and source from staged text and its pattern and keyword hits."""
    empty = F.coalesce(text, F.lit("")) == ""
    mentioned = F.col(LOWERED).contains("license") & F.col(LOWERED).rlike(_MENTION)

    def pick(on_empty, on_pattern, on_keyword, on_mention, on_nothing):
        return (
            F.when(empty, on_empty)
            .when(pattern.isNotNull(), on_pattern)
            .when(keyword.isNotNull(), on_keyword)
            .when(mentioned, on_mention)
            .otherwise(on_nothing)
        )

    found = F.coalesce(pattern, keyword)
    return {
        "license_type": F.when(empty, "UNKNOWN").otherwise(F.coalesce(found, F.lit("UNKNOWN"))),
        "confidence": pick(
            fixed.UNKNOWN_CONFIDENCE, fixed.PATTERN_CONFIDENCE, fixed.KEYWORD_CONFIDENCE, fixed.MENTION_CONFIDENCE,
            fixed.UNKNOWN_CONFIDENCE,
        ),
        "allows_commercial": ~empty & F.coalesce(allows_commercial(found, rules), F.lit(False)),
        "source": pick("empty_input", "pattern_match", "keyword_match", "generic_mention", "not_found"),
    }


def text_of_json(json: Column) -> Column:
    """What to search in a JSON value: the licence field of an object, the joined items of a list, else the text."""
    parsed = F.try_parse_json(json)
    kind = F.schema_of_variant(parsed)
    result = json
    for key in reversed(fixed.LICENSE_JSON_KEYS):
        field = F.try_variant_get(parsed, f"$.{key}", "string")
        result = F.when(field.isNotNull(), field).otherwise(result)
    items = F.array_join(F.try_variant_get(parsed, "$", "array<string>"), " ")
    return F.when(kind.startswith("ARRAY"), items).when(kind.startswith("OBJECT"), result).otherwise(json)


def ml_friendly(license_type: Column, strict: bool = False) -> Column:
    """Any type but ``UNKNOWN``; ``strict`` demands a known licence that allows commercial use."""
    if strict:
        return F.coalesce(allows_commercial(license_type), F.lit(False))
    return F.coalesce(license_type != "UNKNOWN", F.lit(True))
