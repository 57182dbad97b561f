"""Cleaning recipes: the record, the two ways to derive one from a profile, validation, and reading one from text."""

from __future__ import annotations

import dataclasses
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.operators.profile import profile_insights, profile_rows

OUTLIER_STRATEGIES = ("clip", "drop", "keep")
IMPUTE_STRATEGIES = ("mean", "median", "mode", "drop_rows", "keep")


@dataclass(frozen=True)
class Recipe:
    target_column: str | None = None
    outlier_strategy: str = "keep"
    impute_strategy: str = "drop_rows"
    type_conversions: dict[str, str] = field(default_factory=dict)
    drop_columns: list[str] = field(default_factory=list)
    confidence: float = 0.0
    reasoning: str = ""

    def __post_init__(self) -> None:
        if self.outlier_strategy not in OUTLIER_STRATEGIES:
            raise ValueError(f"outlier_strategy must be one of {OUTLIER_STRATEGIES}")
        if self.impute_strategy not in IMPUTE_STRATEGIES:
            raise ValueError(f"impute_strategy must be one of {IMPUTE_STRATEGIES}")
        if not 0.0 <= self.confidence <= 1.0:
            raise ValueError("confidence must lie in [0, 1]")

    def frame(self, spark) -> DataFrame:
        """One row; lists and mappings as text, names in their given order."""
        row = (
            self.target_column,
            self.outlier_strategy,
            self.impute_strategy,
            ",".join(f"{c}:{t}" for c, t in self.type_conversions.items()),
            ",".join(self.drop_columns),
            self.confidence,
        )
        return spark.createDataFrame(
            [row],
            "target_column string, outlier_strategy string, impute_strategy string, type_conversions string,"
            " drop_columns string, confidence double",
        ).coalesce(1)


def default_recipe(profile: DataFrame) -> Recipe:
    """Drop columns that are over 90 % null, forward-fill the rest, keep outliers, take the first target candidate."""
    candidates = profile_insights(profile).first()["target_candidates"]
    empty = [c for c, s in profile_rows(profile).items() if s["null_percentage"] > fixed.DROP_ABOVE_NULL_PCT]
    return Recipe(
        target_column=candidates[0] if candidates else None,
        impute_strategy="mode",
        drop_columns=empty,
        confidence=0.5,
        reasoning="columns that are almost empty dropped, gaps forward-filled",
    )


def rule_actions(profile: DataFrame) -> DataFrame:
    """Per column: what the recipe rules ask for.

    Outliers: clip below 20 %, else keep. Missing: drop rows below 5 %, impute from 5 to 30 % (mean, or median where
    skewed, for numbers; mode for the rest), else keep. Target: categorical with 2 to 50 distinct values.
    """
    numeric = F.col("type") == "numeric"
    outliers = F.coalesce(F.col("outlier_count"), F.lit(0))
    outlier = F.when(numeric & (outliers > 0) & (F.col("outlier_percentage") < 20), "clip").otherwise("keep")
    missing = F.col("null_percentage")
    impute = (
        F.when((missing == 0) | (missing > 30), "keep")
        .when(missing < 5, "drop_rows")
        .when(numeric & F.coalesce(F.col("is_skewed"), F.lit(False)), "median")
        .when(numeric, "mean")
        .otherwise("mode")
    )
    target = (F.col("type") == "categorical") & F.col("unique_count").between(2, 50)
    return profile.select(
        "column",
        "position",
        outlier.alias("outlier_action"),
        impute.alias("impute_action"),
        F.coalesce(target, F.lit(False)).alias("is_target"),
        (missing > fixed.DROP_ABOVE_NULL_PCT).alias("drop_column"),
    )


def rule_recipe(profile: DataFrame) -> Recipe:
    """One recipe from the per-column actions: clip if any column asks for it, most frequent imputation."""
    rows = sorted(rule_actions(profile).collect(), key=lambda r: r["position"])
    votes = Counter(r["impute_action"] for r in rows if r["impute_action"] != "keep" and not r["drop_column"])
    order = ("drop_rows", "mean", "median", "mode")
    impute = max(order, key=lambda s: (votes[s], -order.index(s))) if votes else "keep"
    targets = [r["column"] for r in rows if r["is_target"]]
    return Recipe(
        target_column=targets[0] if targets else None,
        outlier_strategy="clip" if any(r["outlier_action"] == "clip" for r in rows) else "keep",
        impute_strategy=impute,
        drop_columns=[r["column"] for r in rows if r["drop_column"]],
        confidence=0.5,
        reasoning="majority of per-column rules",
    )


def validate_recipe(recipe: Recipe, profile: DataFrame) -> Recipe:
    """Remove what refers to no column; mean and median give way to mode if a categorical column has gaps."""
    stats = profile_rows(profile)
    impute = recipe.impute_strategy
    if impute in ("mean", "median") and any(
        s["null_percentage"] > 0 and s["type"] == "categorical" for s in stats.values()
    ):
        impute = "mode"
    return dataclasses.replace(
        recipe,
        target_column=recipe.target_column if recipe.target_column in stats else None,
        impute_strategy=impute,
        type_conversions={c: t for c, t in recipe.type_conversions.items() if c in stats},
        drop_columns=[c for c in recipe.drop_columns if c in stats],
    )


def fenced_text(content: Column) -> Column:
    """The inside of the first ```json block, else of the first ``` block, else the whole text."""
    tagged = F.split(content, "```json", -1)
    plain = F.split(content, "```", -1)
    inner = (
        F.when(content.contains("```json"), F.split(F.get(tagged, F.lit(1)), "```", -1)[0])
        .when(content.contains("```"), F.get(plain, F.lit(1)))
        .otherwise(content)
    )
    return F.trim(inner)


def parse_fenced_json(df: DataFrame, column: str, schema: str, out: str = "parsed") -> DataFrame:
    """Read the JSON inside a text column into a struct; null where it is not valid JSON."""
    text = fenced_text(F.col(column))
    valid = F.try_parse_json(text).isNotNull()
    return df.withColumn(out, F.when(valid, F.from_json(text, schema)))
