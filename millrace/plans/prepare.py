"""From a raw table to exported splits: profile, recipe, cleaning, split, export, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.functions import fixed_values as fixed
from millrace.operators.clean import Audit, apply_recipe
from millrace.operators.profile import column_profile
from millrace.operators.recipe import Recipe, default_recipe, validate_recipe
from millrace.operators.split import detect_strategy, split
from millrace.session import scratch_path
from millrace.sources.readers import head_rows
from millrace.sources.writers import FORMATS, export_split


@dataclass
class Prepared:
    profile: DataFrame
    recipe: Recipe
    audit: Audit
    strategy: str
    manifest: DataFrame
    summary: DataFrame


def prepare(
    df: DataFrame,
    path: str,
    name: str,
    key: list[str],
    order_by: list[str],
    recipe: Recipe | None = None,
    target: str | None = None,
    max_rows: int | None = None,
    formats: tuple[str, ...] = FORMATS,
    ratios: tuple[float, float, float] = fixed.SPLIT_RATIOS,
    seed: int = fixed.SPLIT_SEED,
    reprofile: bool = False,
) -> Prepared:
    """Run the whole preparation. ``key`` and ``order_by`` must be unique and survive the recipe.

    The cleaned table is written to the shared folder once: splitting reads it several times, and lost executors must
    not cause the cleaning to run again. Counts of stored tables come from file footers or from the writes.
    """
    spark = df.sparkSession
    if max_rows is not None:
        df = head_rows(df, max_rows, order_by)
    profile = column_profile(df, order_by)
    recipe = validate_recipe(recipe or default_recipe(profile), profile)
    target = target or recipe.target_column
    original_rows = df.count()
    cleaned, audit = apply_recipe(df, recipe, profile, order_by, reprofile=reprofile, observe=True)
    stored = scratch_path(spark, f"{name}-cleaned")
    cleaned.write.parquet(stored)
    cleaned = spark.read.parquet(stored)
    cleaned_rows = cleaned.count()  # from the file footers

    strategy = detect_strategy(profile, target)
    if strategy == "stratified" and target not in cleaned.columns:
        strategy = "random"
    labelled = split(cleaned, strategy, key, order_by, target, ratios, seed)
    manifest = export_split(labelled, f"{path}/{name}", "ml_ready", formats)
    rows = {r["split"]: r["rows"] for r in manifest.collect()}
    summary = spark.createDataFrame(
        [
            (
                name, original_rows, cleaned_rows,
                rows.get("train", 0), rows.get("test", 0), rows.get("val", 0), recipe.impute_strategy, strategy,
            )
        ],
        "dataset_name string, original_rows bigint, cleaned_rows bigint, train_rows bigint, test_rows bigint,"
        " val_rows bigint, cleaning string, splitting string",
    ).coalesce(1)
    return Prepared(profile, recipe, audit, strategy, manifest, summary)

