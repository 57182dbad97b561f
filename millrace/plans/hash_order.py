"""Rows in seeded hash order, without sorting the table.

The md5 text of a unique key is spread evenly, so the row at an exact position in hash order is found from a count per
hash prefix and a look into the one prefix that holds the position. Rows are then chosen by comparing with that row:
a projection or filter over the scan. The same rows come out for every partitioning and after every task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.ordered import typed_literal

ROWS_PER_PREFIX = 50_000
MAX_PREFIX_DIGITS = 4
HASH = "_hash"


def seeded_hash(key: list[str], seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.concat_ws("|", *[F.col(k).cast("string") for k in key])))


def prefix_digits(rows: int) -> int:
    """Hex digits so that a prefix holds some ten thousand rows, within 65,536 prefixes."""
    return min(max(math.ceil(math.log(max(rows / ROWS_PER_PREFIX, 1), 16)), 1), MAX_PREFIX_DIGITS)


def row_marker(key: list[str], seed: int) -> Column:
    """What rows are compared by: hash, then key."""
    return F.struct(seeded_hash(key, seed).alias(HASH), *[F.col(k) for k in key])


def marker_at(df: DataFrame, key: list[str], seed: int, positions: list[int], total: int) -> dict[int, Column]:
    """The marker literals of the rows at 0-based positions in hash order."""
    positions = sorted({p for p in positions if 0 <= p < total})
    if not positions:
        return {}
    digits = prefix_digits(total)
    hashed = df.select(seeded_hash(key, seed).alias(HASH), *key)
    prefix = F.substring(HASH, 1, digits)
    counts = hashed.groupBy(prefix.alias("prefix")).count().collect()  # at most 16 ** digits rows
    homes, before = {}, 0
    for r in sorted(counts, key=lambda r: r["prefix"]):
        for p in positions:
            if before <= p < before + r["count"]:
                homes[p] = (r["prefix"], p - before)
        before += r["count"]
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(HASH, *key)) - 1
    wanted = F.lit(False)
    for p, offset in homes.values():
        wanted = wanted | ((F.col("prefix") == p) & (F.col("rank") == offset))
    rows = (
        hashed.withColumn("prefix", prefix)
        .filter(F.col("prefix").isin(sorted({p for p, _ in homes.values()})))
        .withColumn("rank", rank)
        .filter(wanted)
        .select("prefix", "rank", HASH, *[F.col(k).cast("string").alias(k) for k in key])
        .collect()
    )
    found = {(r["prefix"], r["rank"]): r for r in rows}
    markers = {}
    for p, home in homes.items():
        r = found[home]
        parts = [typed_literal(r[k], df.schema[k].dataType).alias(k) for k in key]
        markers[p] = F.struct(F.lit(r[HASH]).alias(HASH), *parts)
    return markers


def smallest_hashes(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in hash order."""
    total = df.count()
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    last = marker_at(df, key, seed, [n - 1], total)[n - 1]
    return df.filter(row_marker(key, seed) <= last)
