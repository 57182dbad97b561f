"""Joining a table with one row per key to rows of which one key may hold a large share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import all_of

#: Rows of one key that a task may join; a key with more is salted.
ROWS_PER_SALT = 1_000_000
#: Keys that are salted at most, those with the most rows. Any other key holds less than this share of all rows.
MOST_SALTED = 1024


def join_per_key(
    df: DataFrame,
    per_key: DataFrame,
    keys: dict[str, str],
    spread_by: list[str],
    rows: str,
    how: str = "inner",
    small: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``per_key`` (unique by its key columns) to ``df``; ``keys`` maps columns of ``df`` to those of ``per_key``.

    ``rows`` is a column of ``per_key`` with the number of rows that ``df`` has of the key, or a bound of it. A side the caller has counted to
    be small is broadcast. Otherwise keys of more than ``rows_per_salt`` rows are repeated once per so many rows, and their rows in ``df``
    pick a salt by the hash of ``spread_by``, so that many tasks join them; all other keys are joined as they are. The table of
    salted keys, ``MOST_SALTED`` at most, is broadcast. Null keys match. ``rows`` and the key columns of ``per_key`` are dropped.
    """
    match = [F.col(ours).eqNullSafe(F.col(theirs)) for ours, theirs in keys.items()]
    if small:
        return df.join(F.broadcast(per_key), all_of(match), how).drop(rows, *keys.values())
    most = per_key.filter(F.col(rows) > rows_per_salt).orderBy(F.desc(rows), *keys.values()).limit(MOST_SALTED)
    hot = [f"_hot{i}" for i in range(len(keys))]
    salts = F.ceil(F.col(rows) / rows_per_salt).cast("int").alias("_salts")
    hot_keys = F.broadcast(most.select(*[F.col(k).alias(h) for k, h in zip(keys.values(), hot, strict=True)], salts))

    def with_salts(side: DataFrame, columns) -> DataFrame:
        on = all_of([F.col(c).eqNullSafe(F.col(h)) for c, h in zip(columns, hot, strict=True)])
        return side.join(hot_keys, on, "left").drop(*hot).withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    repeated = with_salts(per_key, keys.values()).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    salted = with_salts(df, keys).withColumn("_own_salt", F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")).drop("_salts")
    joined = salted.join(repeated, all_of([*match, F.col("_own_salt") == F.col("_salt")]), how)
    return joined.drop("_salt", "_own_salt", rows, *keys.values())
