"""Searching and ranking catalogues of dataset candidates.

A candidates table has one row per (search, candidate): ``search`` names the search a row answers (many searches are
ranked in one job), ``arrival`` gives the order in which results came in. Groups are never gathered: counts are
pre-aggregated, and first-wins and top-k picks limit rows before their shuffle.

Choices: the licence test accepts any identifier but ``UNKNOWN`` unless ``strict``; a missing file extension counts
as known metadata; extra metadata is page metadata columns where the table has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions import licenses as lic
from millrace.functions.cells import any_of
from millrace.plans.per_key import join_per_key

CANDIDATE_COLUMNS = [
    "source_id", "url", "source_type", "is_downloadable", "size_mb", "file_extension", "downloads", "likes", "votes",
    "usability", "description", "compliance_score",
]


# --- normalising ---


def normalize_candidates(df: DataFrame, source: str) -> DataFrame:
    """Source records to candidates: id to page URL, bytes to MB, default extension, missing counts to 0.

    Catalogue records carry id, size_bytes, downloads, likes, votes, usability (missing columns allowed); web results
    carry url, title, snippet.
    """
    if source not in fixed.SOURCE_TYPES:
        raise ValueError(f"unknown source: {source}")

    def number(name: str, dtype: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(dtype) if name in df.columns else F.lit(0).cast(dtype)

    web = source == "web_scrape"
    values = {
        "source_id": F.col("title" if web else "id").cast("string"),
        "url": F.col("url") if web else F.concat(F.lit(fixed.DATASET_PAGE[source]), F.col("id").cast("string")),
        "source_type": F.lit(source),
        "is_downloadable": F.lit(not web),
        "size_mb": F.lit(0.0) if web else number("size_bytes", "double") / (1024 * 1024),
        "file_extension": F.lit(fixed.DEFAULT_EXTENSION[source]),
        "downloads": number("downloads", "bigint"),
        "likes": number("likes", "bigint"),
        "votes": number("votes", "bigint"),
        "usability": number("usability", "double"),
        "description": F.col("snippet") if web else F.lit(None).cast("string"),
        "compliance_score": F.lit(fixed.WEB_SCORE if web else 0.0),
    }
    made = [c for c in df.columns if c not in values and c not in ("id", "size_bytes", "title", "snippet")]
    return df.select(*made, *[v.alias(n) for n, v in values.items()])


# --- gathering ---


def waterfall(
    df: DataFrame, limit: int, by: list[str], order_by: list[str], sources: tuple[str, ...] = tuple(fixed.SOURCE_TYPES)
) -> DataFrame:
    """Per search: the first source's results, the second's only if the first gave fewer than ``limit``, the third's
    only if fewer than three results came so far. Catalogue sources give at most ``limit`` results each.

    The counts per search are aggregated first (one row per search and source) and decide by a join on the search.
    """
    first, second, third = sources
    ranked = Window.partitionBy(*by, "source_type").orderBy(*order_by)
    offered = df.withColumn("_rank", F.row_number().over(ranked)).filter(
        (F.col("_rank") <= limit) & (F.col("source_type") != third)
    )
    offered = offered.drop("_rank").unionByName(df.filter(F.col("source_type") == third))

    def found(source: str) -> Column:
        return F.least(F.count_if(F.col("source_type") == source), F.lit(limit))

    counts = df.groupBy(*by).agg(found(first).alias("_first"), found(second).alias("_second"), F.count("*").alias("_rows"))
    with_second = F.col("_first") < limit
    so_far = F.col("_first") + F.when(with_second, F.col("_second")).otherwise(0)
    wanted = (
        F.when(F.col("source_type") == first, True)
        .when(F.col("source_type") == second, with_second)
        .otherwise(so_far < fixed.LAST_RESORT_BELOW)
    )
    gates = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_first", "_second", "_rows")
    gated = join_per_key(offered, gates, {c: f"_by_{c}" for c in by}, order_by, "_rows")
    return gated.filter(wanted).select(*df.columns)


def accumulate(
    df: DataFrame,
    limit: int,
    by: list[str],
    order_by: list[str],
    variant: str = "variant",
    most: int | None = None,
) -> DataFrame:
    """Results of a search's query variants (numbered from 0), until twice ``limit`` have come; of the first ``most`` variants if given."""
    counts = (df if most is None else df.filter(F.col(variant) < most)).groupBy(*by, variant).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy(variant).rowsBetween(Window.unboundedPreceding, -1)  # one row per variant
    open_ = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).filter(
        F.col("_before") < 2 * limit
    )
    keys = {c: f"_by_{c}" for c in [*by, variant]}
    return join_per_key(df, open_.select(*[F.col(c).alias(k) for c, k in keys.items()], "_rows"), keys, order_by, "_rows")


def dedup(df: DataFrame, order_by: list[str], by: list[str], key: str = "source_id") -> DataFrame:
    """First arrival per id. The rank limit runs before the shuffle, so a much repeated id stays small."""
    first = Window.partitionBy(*by, key).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")


def drop_blacklisted(df: DataFrame, words: list[str] = fixed.ID_BLACKLIST) -> DataFrame:
    lowered = F.lower("source_id")
    return df.filter(~any_of([lowered.contains(w) for w in words]))


# --- scoring ---


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def score_license(df: DataFrame, strict: bool = False) -> Column:
    """1 for an acceptable licence, 0 for none; page metadata (``page_license``) comes before file metadata."""
    page = F.nullif(_optional(df, "page_license"), F.lit(""))
    found = F.coalesce(page, F.nullif(_optional(df, "license"), F.lit("")))
    if strict:
        unknown = found.isNull() | (F.upper(found) == "UNKNOWN")
        return F.when(unknown, 0.0).when(lic.ml_friendly(found, strict=True), 1.0).otherwise(0.5)
    return F.when(found.isNull() | (found == "UNKNOWN"), 0.0).otherwise(1.0)


def score_metadata(df: DataFrame) -> Column:
    """A quarter each for a size, an extension, a name and a description."""
    parts = [
        F.coalesce(F.col("size_mb") > 0, F.lit(False)),
        F.coalesce(F.col("file_extension") != "unknown", F.lit(True)),
        F.coalesce(_optional(df, "dataset_name") != "", F.lit(False)),
        F.coalesce(_optional(df, "page_description") != "", F.lit(False)),
    ]
    total = F.lit(0.0)
    for p in parts:
        total = total + F.when(p, 0.25).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def score_format(df: DataFrame) -> Column:
    extension = F.lower("file_extension")
    result = F.lit(0.0)
    for score, extensions in reversed(fixed.FORMAT_SCORES):
        result = F.when(extension.isin(extensions), score).otherwise(result)
    return result


def score_breakdown(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add the raw scores, the weighted components and ``total_score``."""
    w = fixed.SCORE_WEIGHTS
    raw = df.withColumns(
        {
            "raw_license": score_license(df, strict),
            "raw_metadata": score_metadata(df),
            "raw_format": score_format(df),
            "downloadable": F.when(F.col("is_downloadable"), w["downloadable"]).otherwise(0.0),
        }
    )
    total = (
        F.col("raw_license") * w["license"]
        + F.col("downloadable")
        + F.col("raw_metadata") * w["metadata"]
        + F.col("raw_format") * w["format"]
    )
    return raw.withColumns(
        {
            "license_part": F.round(F.col("raw_license") * w["license"], 2),
            "metadata_part": F.round(F.col("raw_metadata") * w["metadata"], 2),
            "format_part": F.round(F.col("raw_format") * w["format"], 2),
            "total_score": F.round(total, 2),
        }
    )


def compliance_score(df: DataFrame, strict: bool = False) -> DataFrame:
    """Set ``compliance_score``: .4 licence + .3 downloadable + .2 metadata + .1 format, two digits."""
    scored = score_breakdown(df, strict).withColumn("compliance_score", F.col("total_score"))
    return scored.select(*df.columns, *([] if "compliance_score" in df.columns else ["compliance_score"]))


def top_candidates(df: DataFrame, limit: int, order_by: list[str], by: list[str] | None = None) -> DataFrame:
    """Best ``limit`` by score, earlier arrival first among equals; per search if ``by`` is given."""
    order = [F.desc("compliance_score"), *order_by]
    if not by:
        return df.orderBy(*order).limit(limit)
    ranked = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= limit).drop("_rank")


def rank_candidates(
    df: DataFrame, limit: int, by: list[str], order_by: list[str], blacklist: list[str] = fixed.ID_BLACKLIST,
    strict: bool = False,
) -> DataFrame:
    """De-duplicate, filter, score, and keep the best per search."""
    unique = drop_blacklisted(dedup(df, order_by, by), blacklist)
    return top_candidates(compliance_score(unique, strict), limit, order_by, by)


def intelligent_search(df: DataFrame, limit: int, by: list[str], order_by: list[str], variant: str = "variant") -> DataFrame:
    """Waterfall per query variant, accumulation over variants, then ranking per search."""
    offered = waterfall(df, limit, [*by, variant], order_by)
    return rank_candidates(accumulate(offered, limit, by, order_by, variant), limit, by, [variant, *order_by])


def popularity(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add downloads + votes + likes; the first arrival of each URL only."""
    total = F.lit(0).cast("bigint")
    for c in ("downloads", "votes", "likes"):
        if c in df.columns:
            total = total + F.coalesce(F.col(c), F.lit(0))
    return dedup(df.withColumn("popularity", total), [F.desc("popularity"), *order_by], [], "url")


# --- single records ---


def route_ids(df: DataFrame, column: str = "source_id") -> DataFrame:
    """Where an id leads: ``owner/name`` to the second catalogue, anything else to the first."""
    slashed = F.col(column).contains("/") & ~F.col(column).startswith("http")
    second, first = "kaggle", "huggingface"
    return df.withColumns(
        {
            "source_type": F.when(slashed, second).otherwise(first),
            "url": F.concat(
                F.when(slashed, fixed.DATASET_PAGE[second]).otherwise(fixed.DATASET_PAGE[first]), F.col(column)
            ),
            "file_extension": F.when(slashed, "xlsx").otherwise("parquet"),
            "compliance_score": F.lit(0.5),
        }
    )


def validate_candidates(df: DataFrame) -> DataFrame:
    """Add ``reasons`` (all rule violations) and ``is_valid``: required fields, URL form, source, score ranges."""

    def out_of_range(name: str) -> Column:
        return F.coalesce((F.col(name) < 0) | (F.col(name) > 1) | F.isnan(name), F.lit(False))

    checks = [
        (F.col("source_id").isNull(), "missing source_id"),
        (~F.coalesce(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False)), "bad url"),
        (~F.coalesce(F.col("source_type").isin(fixed.SOURCE_TYPES), F.lit(False)), "bad source_type"),
        (F.col("is_downloadable").isNull(), "missing is_downloadable"),
    ]
    if "compliance_score" in df.columns:
        checks.append((out_of_range("compliance_score"), "score out of range"))
    if "license_confidence" in df.columns:
        checks.append((out_of_range("license_confidence"), "confidence out of range"))
    reasons = F.array_compact(F.array(*[F.when(bad, reason) for bad, reason in checks]))
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)
