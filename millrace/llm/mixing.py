"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, in DataFrame operations only.

Sources get targets in tokens from their weights, no more than ``most_repeats`` times what they have. The mix is cut in
blocks of ``block_tokens``. Blocks go to sources by highest quotients ``target / (seats + 1/2)``, then within a source to
its shards the same way, by the tokens a shard holds: every shard gets an integer quota. A shard is the documents of a
source whose seeded hash falls in it, about ``shard_tokens`` of them however large the source, so no task ever holds a source. In a shard,
documents lie end to end in seeded order; a quota takes the first blocks of that order, and starts over behind the last.

Highest quotients need no queue: rounding ``target / block`` gives all seats but a few, at most half as many as there
are parties; only the quotients next in line around that are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import named, staged, words_of


def apportion(parties: DataFrame, within: list[str], claim: str, total: str, order: list[str], into: str) -> DataFrame:
    """Divide ``total`` seats among the parties of each group by highest quotients ``claim / (seats + 1/2)``.

    ``total`` is a column that is constant in a group. Ties go to the first by ``order``. Claims must not be negative;
    a group without claims gets no seats.
    """
    rows = _with_sum(parties, within, claim, "_claims")
    unit = F.when((F.col("_claims") > 0) & (F.col(total) > 0), F.col("_claims") / F.col(total))
    rows = rows.withColumn("_share", F.coalesce(F.col(claim) / unit, F.lit(0.0)))
    rows = rows.withColumn("_seats", F.floor(F.col("_share") + 0.5).cast("long"))
    rows = _with_sum(rows, within, "_seats", "_given")
    rows = rows.withColumn("_missing", F.when(unit.isNotNull(), F.col(total) - F.col("_given")).otherwise(F.lit(0)))
    rows = rows.drop("_given")
    # A party's further seats, or those it may have to give back, are in proportion to its share of them.
    reach = F.ceil(F.abs("_missing") * F.col("_share") / F.greatest(F.col(total), F.lit(1))).cast("int") + 1
    steps = F.when(F.col("_missing") != 0, F.sequence(F.lit(0), reach)).otherwise(F.array().cast("array<int>"))
    moves = rows.select(*within, *order, "_missing", "_seats", "_share", F.explode(steps).alias("_step"))
    gained = F.col("_missing") > 0
    at = F.when(gained, F.col("_seats") + F.col("_step")).otherwise(F.col("_seats") - 1 - F.col("_step"))
    moves = moves.filter((at >= 0) & (F.col("_share") > 0)).withColumn("_quotient", F.col("_share") / (at + 0.5))
    ranked = Window.partitionBy(*[named(c) for c in within] or [F.lit(0)])
    first = F.when(gained, -F.col("_quotient")).otherwise(F.col("_quotient"))
    tie = F.when(gained, F.lit(1)).otherwise(F.lit(-1))
    place = F.row_number().over(ranked.orderBy(first, *[tie * F.col(c) for c in order], "_step"))
    moves = moves.withColumn("_place", place).filter(F.col("_place") <= F.abs("_missing"))
    moved = moves.groupBy(*within, *order).agg(F.sum(F.signum("_missing")).cast("long").alias("_moved"))
    rows = rows.join(moved, [*within, *order], "left")
    return rows.withColumn(into, F.col("_seats") + F.coalesce("_moved", F.lit(0))).drop(
        "_claims", "_share", "_seats", "_missing", "_moved"
    )


def _with_sum(rows: DataFrame, within: list[str], column: str, into: str) -> DataFrame:
    """``rows`` with the sum of a column over their group; that of all rows is one number, which the driver reads."""
    if within:
        return rows.join(rows.groupBy(*within).agg(F.sum(column).alias(into)), within)
    return rows.withColumn(into, F.lit(rows.agg(F.sum(column)).first()[0]))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most_repeats: float) -> DataFrame:
    """Targets of the sources: ``share`` of all tokens by weight, none above ``most_repeats`` times its size.

    ``sizes`` has ``_source`` and ``source_size``. Weights repeat over the sources in code-point order, null last. What
    a source can not take goes to the others by weight until none is above; the level of tokens per weight only rises, and each
    round on the driver sees two sums.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_number", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_weight", F.get(cycle, (F.col("_number") % len(weights)).cast("int")))
    ranked = ranked.withColumn("_most", F.col("source_size") * most_repeats)
    sums = ranked.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    total = min(share, most_repeats) * (sums["size"] or 0)
    level = total / sums["weight"] if sums["weight"] else 0.0
    while True:
        full = F.col("_most") <= F.col("_weight") * level
        got = ranked.agg(
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)).alias("most"), F.sum(F.when(~full, F.col("_weight")).otherwise(0.0)).alias("open")
        ).first()
        if not got["open"]:
            break
        risen = (total - got["most"]) / got["open"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return ranked.withColumn("target", F.least("_most", F.col("_weight") * level)).drop("_most")


def mix_sources(
    docs: DataFrame, weights: list[float], share: float = 1.5, most_repeats: int = 2, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", block_tokens: int = 64, shard_tokens: int = 2_000_000, seed: int = 17,
    work: str | None = None,
) -> DataFrame:
    """What a mix takes of every document: ``id_col, source_col, size, source_size, target, quota, taken``, one row per row.

    ``size`` counts words; a null text has none. ``quota`` is that of the document's shard in blocks, ``taken`` the words taken, repeats
    counted, never above ``most_repeats`` times the size. Null sources are one source, the last. Rows that share an id
    are documents of their own; equal rows may swap places. The same seed gives the same mix however the rows are
    partitioned. Empty tables give empty results. Other columns are not read. Ranking all sources is the only step in one
    task; it sees one row per source.
    """
    text = named(text_col)
    sized = docs.select(
        named(id_col).alias("_id"), named(source_col).alias("_source"), F.size(words_of(text)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), named(id_col), named(source_col), text).alias("_place"),
    )
    sized = staged(sized, "mix-sizes", work)
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sources = staged(source_targets(sources, weights, share, most_repeats), "mix-sources", work)
    total = F.round(F.lit(sources.agg(F.sum("target")).first()[0] or 0.0) / block_tokens).cast("long")
    sources = apportion(sources.withColumn("_total", total), [], "target", "_total", ["_number"], "_quota")
    sources = sources.withColumn("_shards", F.ceil((F.col("source_size") + 1) / shard_tokens).cast("int"))
    sources = staged(sources.drop("_total", "_weight"), "mix-quotas", work)
    same = F.col("_source").eqNullSafe(F.col("_of"))
    known = sources.withColumnRenamed("_source", "_of")
    placed = sized.join(known, same).drop("_of").withColumn("_shard", F.pmod("_place", "_shards"))
    shards = placed.groupBy("_number", "_shard", "_quota").agg(F.sum("size").alias("_held"))
    quotas = apportion(shards, ["_number"], "_held", "_quota", ["_shard"], "quota").select("_number", "_shard", "_held", "quota")
    placed = placed.drop("_quota", "_shards").join(quotas, ["_number", "_shard"])
    order = Window.partitionBy("_number", "_shard").orderBy("_place", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    # Quotas are rounded to blocks, so they may be a fraction of a block above what repeats allow.
    wanted = F.least(F.col("quota") * block_tokens, F.col("_held") * most_repeats)
    return laid.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "quota",
        _taken(wanted, F.col("_held"), F.col("_start"), F.col("size")).alias("taken"),
    )


def _taken(wanted: Column, held: Column, start: Column, size: Column) -> Column:
    """Tokens of a document at ``start`` among the first ``wanted`` tokens of its shard, which repeats after ``held``."""
    whole = F.when(held > 0, F.floor(wanted / held)).otherwise(F.lit(0))
    rest = wanted - whole * held
    return (whole * size + F.greatest(F.lit(0), F.least(size, rest - start))).cast("long")
