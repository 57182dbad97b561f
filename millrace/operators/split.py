"""Train / test / validation splits as one frame with a ``split`` column.

Sizes are floor(n * ratio) overall or per class; what rounding leaves over is ``val`` when a validation share is asked
for and is dropped otherwise. No split sorts or shuffles the table: the boundary rows are found first (from counts per
hash prefix or per slice of the order), then each row is labelled by comparing it with them.

Choices: rows without a class are dropped by the stratified split unless ``keep_nulls``; the temporal split needs an
explicit order, as Spark rows have none. ``mode="fast"`` labels by hash threshold: one scan, sizes only approximate,
labels stable when rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.operators.profile import profile_rows
from millrace.plans import hash_order, ordered
from millrace.plans.per_key import join_per_key

STRATEGIES = ("random", "stratified", "temporal")
SPLIT = "split"
BROADCAST_CLASSES = 10_000


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1.0) > fixed.SPLIT_TOLERANCE:
        raise ValueError(f"ratios must sum to 1.0, got {sum(ratios)}")


def split_sizes(n: int, ratios: tuple[float, float, float]) -> tuple[int, int]:
    """End positions of train and test."""
    train = int(n * ratios[0])
    return train, train + int(n * ratios[1])


def split(
    df: DataFrame,
    strategy: str = "random",
    key: list[str] | None = None,
    order_by: list[str] | None = None,
    target: str | None = None,
    ratios: tuple[float, float, float] = fixed.SPLIT_RATIOS,
    seed: int = fixed.SPLIT_SEED,
    mode: str = "exact",
    keep_nulls: bool = False,
) -> DataFrame:
    """Add ``split``. ``key`` must be unique (random, stratified); ``order_by`` must be unique (temporal)."""
    strategy = strategy.lower()
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    check_ratios(ratios)
    if any("." in c or "`" in c for c in df.columns):
        short = {c: f"_c{i}" for i, c in enumerate(df.columns)}
        plain = [[short[c] for c in cs] if cs else cs for cs in (key, order_by)]
        out = split(df.toDF(*short.values()), strategy, *plain, short.get(target, target), ratios, seed, mode, keep_nulls)
        return out.toDF(*short, SPLIT)
    if strategy == "temporal":
        if not order_by:
            raise ValueError("order_by required for temporal split")
        return _split_temporal(df, order_by, ratios)
    if not key:
        raise ValueError("key required for random and stratified split")
    if strategy == "stratified" and not target:
        raise ValueError("target required for stratified split")
    if strategy == "stratified" and not keep_nulls:
        df = df.filter(F.col(target).isNotNull())
    if mode == "fast":
        return _split_fast(df, key, ratios, seed)
    if strategy == "stratified":
        return _split_stratified(df, target, key, ratios, seed)
    return _split_random(df, key, ratios, seed)


def _labelled(
    df: DataFrame, row: Column, train_end: Column | None, test_end: Column | None, with_val: bool
) -> DataFrame:
    """Label by comparison; a missing (or null) end means that no row comes before it."""
    marked = df.withColumn("_row", row)
    before = [F.lit(False) if end is None else F.col("_row") <= end for end in (train_end, test_end)]
    label = F.when(before[0], "train").when(before[1], "test")
    if with_val:
        return marked.withColumn(SPLIT, label.otherwise("val")).drop("_row")
    return marked.withColumn(SPLIT, label).filter(F.col(SPLIT).isNotNull()).drop("_row")


def _ends(
    found: dict[int, Column], n: int, ratios: tuple[float, float, float]
) -> tuple[Column | None, Column | None]:
    train, test = split_sizes(n, ratios)
    return found.get(train - 1), found.get(test - 1)


def _split_random(df, key, ratios, seed) -> DataFrame:
    n = df.count()
    train, test = split_sizes(n, ratios)
    found = hash_order.marker_at(df, key, seed, [train - 1, test - 1], n)
    return _labelled(df, hash_order.row_marker(key, seed), *_ends(found, n, ratios), ratios[2] > 0)


def _split_temporal(df, order_by, ratios) -> DataFrame:
    n = df.count()
    train, test = split_sizes(n, ratios)
    rows = ordered.rows_at(df, order_by, [train - 1, test - 1])
    found = {p: F.struct(*[v.alias(c) for v, c in zip(r, order_by)]) for p, r in rows.items()}
    return _labelled(df, F.struct(*order_by), *_ends(found, n, ratios), ratios[2] > 0)


def _split_fast(df, key, ratios, seed) -> DataFrame:
    # hex digits compare as texts; a bound of all rows lies behind every digit
    place = hash_order.seeded_hash(key, seed)
    bounds = [int(share * 16**8) for share in (ratios[0], ratios[0] + ratios[1])]
    ends = [f"{b:08x}" if b < 16**8 else "g" for b in bounds]
    label = F.when(place < ends[0], "train")
    if ratios[2] > 0:
        label = label.when(place < ends[1], "test").otherwise("val")
    else:
        label = label.otherwise("test")
    return df.withColumn(SPLIT, label)


def _split_stratified(df, target, key, ratios, seed) -> DataFrame:
    """Per class as for the random split, all classes in the same passes.

    The table of class ends has one row per class. It is broadcast when the classes have been counted to be few;
    otherwise large classes are salted by their counts, so that a class holding much of the table still spreads over many tasks.
    """
    sizes = df.groupBy(target).count()
    few = sizes.limit(BROADCAST_CLASSES + 1).agg(F.count("*"), F.max("count")).first()
    small, largest = few[0] <= BROADCAST_CLASSES, few[1] or 0
    if not small:
        largest = sizes.agg(F.max("count")).first()[0]
    digits = hash_order.prefix_digits(largest)
    cls = F.col(target).alias("_class")
    marks = df.select(cls, hash_order.seeded_hash(key, seed).alias(hash_order.HASH), *key).withColumn(
        "_prefix", F.substring(hash_order.HASH, 1, digits)
    )
    counts = marks.groupBy("_class", "_prefix").agg(F.count("*").alias("_rows"))
    inside = Window.partitionBy("_class")  # at most 16 ** digits rows per class
    below = inside.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_rows").over(inside)
    train = F.floor(total.cast("double") * F.lit(ratios[0]))
    test = train + F.floor(total.cast("double") * F.lit(ratios[1]))
    placed = counts.select(
        "_class",
        "_prefix",
        "_rows",
        total.alias("_size"),
        F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_before"),
        F.array(F.struct(F.lit("train").alias("_end"), (train - 1).alias("_at")),
                F.struct(F.lit("test").alias("_end"), (test - 1).alias("_at"))).alias("_ends"),
    )
    homes = (
        placed.select("*", F.inline("_ends"))
        .filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_rows")))
        .select(
            F.col("_class").alias("_home"), F.col("_prefix").alias("_in"), "_end",
            (F.col("_at") - F.col("_before")).alias("_offset"), "_size",
        )
    )
    homes = F.broadcast(homes) if small else homes
    marker = F.struct(hash_order.HASH, *key)
    rank = F.row_number().over(Window.partitionBy("_class", "_end").orderBy(hash_order.HASH, *key)) - 1
    ends = (
        marks.join(homes, F.col("_class").eqNullSafe(F.col("_home")) & (F.col("_prefix") == F.col("_in")))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_offset"))
        .groupBy("_class")
        .agg(
            F.max(F.when(F.col("_end") == "train", marker)).alias("_train_end"),
            F.max(F.when(F.col("_end") == "test", marker)).alias("_test_end"),
            F.max("_size").alias("_size"),
        )
    )
    joined = join_per_key(df, ends, {target: "_class"}, key, "_size", "left", small)
    row = hash_order.row_marker(key, seed)
    labelled = _labelled(joined, row, F.col("_train_end"), F.col("_test_end"), ratios[2] > 0)
    return labelled.select(*df.columns, SPLIT)


def split_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each class per split."""
    counts = df.groupBy(SPLIT, target).agg(F.count("*").alias("rows"))
    totals = counts.groupBy(SPLIT).agg(F.sum("rows").alias("_total"))  # one row per split
    share = F.col("rows") / F.col("_total")
    return counts.join(F.broadcast(totals), SPLIT).withColumn("share", F.round(share, 4)).drop("_total")


def detect_strategy(profile: DataFrame, target: str | None = None) -> str:
    """Temporal if a time column rises with the rows, else stratified for a small categorical target, else random."""
    rows = profile_rows(profile)
    if any(s["type"] == "temporal" and s["is_monotonic"] for s in rows.values()):
        return "temporal"
    stats = rows.get(target)
    if stats and stats["type"] == "categorical" and stats["unique_count"] < fixed.TARGET_DISTINCT:
        return "stratified"
    return "random"
