"""Gradient boosting of small trees over binned features, its statistics gathered by DataFrame aggregation.

The input is a histogram: one row per combination of bins with the number of cases and of positive ones, so that its size depends on the
features and not on the corpus. Each level of a tree takes one aggregation by (leaf, feature, bin) of the gradients and curvatures of the
logistic loss; the driver sees those sums and chooses the splits. A model is an expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Bins up to ``bin`` of an ordered feature, or just that one of another."""

    feature: str
    bin: int
    ordered: bool

    def holds(self, of: Callable[[str], Column]) -> Column:
        return of(self.feature) <= self.bin if self.ordered else of(self.feature) == self.bin


@dataclass(frozen=True)
class Node:
    split: Split | None
    yes: Node | None = None
    no: Node | None = None
    value: float = 0.0
    leaf: int = 0

    def column(self, of: Callable[[str], Column], wanted: str = "value") -> Column:
        if self.split is None:
            return F.lit(getattr(self, wanted))
        return F.when(self.split.holds(of), self.yes.column(of, wanted)).otherwise(self.no.column(of, wanted))


@dataclass(frozen=True)
class Boosted:
    """Log-odds of a case: a constant and the trees' values."""

    base: float
    trees: tuple[Node, ...] = ()

    def log_odds(self, of: Callable[[str], Column]) -> Column:
        return sum((t.column(of) for t in self.trees), F.lit(self.base))

    def probability(self, of: Callable[[str], Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(of)))


def fit_boosted(
    histogram: DataFrame, features: dict[str, bool], rounds: int = 24, depth: int = 2, rate: float = 0.4, ridge: float = 1.0,
    least_gain: float = 0.5,
) -> Boosted:
    """Trees for the share of ``pos`` among ``n`` in rows of ``histogram``; ``features`` says which ones' bins are ordered.

    Without cases, or with cases of one class only, the model is a constant. Sums are rounded before they are compared, so that the order in which
    tasks finish does not change the trees.
    """
    total = histogram.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    pos, n = total["pos"] or 0, total["n"] or 0
    model = Boosted(round(math.log((pos + 0.5) / (n - pos + 0.5)), 6))
    if not pos or pos == n:
        return model
    bins = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bin")) for f in features])
    for _ in range(rounds):
        tree = Node(None)
        for _ in range(depth):
            p = model.probability(F.col)
            sums = (
                histogram.select(tree.column(F.col, "leaf").alias("leaf"), "pos", "n", p.alias("p"), F.explode(bins).alias("b"))
                .groupBy("leaf", "b.feature", "b.bin")
                .agg(F.sum(F.col("pos") - F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
                .collect()
            )
            tree = _grown(tree, sums, features, rate, ridge, least_gain)
        if tree.split is None:
            break
        model = Boosted(model.base, (*model.trees, tree))
    return model


def _grown(tree: Node, sums: list, features: dict[str, bool], rate: float, ridge: float, least_gain: float) -> Node:
    """``tree`` with each leaf split where that gains most."""
    if tree.split is not None:
        return Node(tree.split, *[_grown(t, sums, features, rate, ridge, least_gain) for t in (tree.yes, tree.no)])
    rows = [r for r in sums if r["leaf"] == tree.leaf]
    by_feature = {f: sorted((r["bin"], r["g"], r["h"]) for r in rows if r["feature"] == f) for f in features}
    any_feature = next(iter(by_feature.values()))
    g_all, h_all = sum(r[1] for r in any_feature), sum(r[2] for r in any_feature)

    def worth(g: float, h: float) -> float:
        return g * g / (h + ridge)

    def value(g: float, h: float) -> float:
        return round(rate * g / (h + ridge), 6)

    best = (least_gain, None, 0.0, 0.0)
    for f, found in by_feature.items():
        g = h = 0.0
        for b, gb, hb in found[: len(found) - 1 if features[f] else None]:
            g, h = (g + gb, h + hb) if features[f] else (gb, hb)
            gain = float(f"{worth(g, h) + worth(g_all - g, h_all - h) - worth(g_all, h_all):.9g}")
            if gain > best[0]:
                best = (gain, Split(f, b, features[f]), g, h)
    _, split, g, h = best
    if split is None:
        return tree
    return Node(
        split, Node(None, value=value(g, h), leaf=2 * tree.leaf + 1), Node(None, value=value(g_all - g, h_all - h), leaf=2 * tree.leaf + 2)
    )


def threshold(scored: list[tuple[float, int, int]], precision: float, z: float = 1.96) -> float:
    """The least score at which, calibrated, a case is positive with a chance of ``precision``; above 1 if there is none.

    ``scored`` has score, positives and number of cases. Scores are calibrated by pooling neighbours until the share of positives falls
    with the score (isotonic regression). A pool counts if its own share reaches ``precision`` and the share of all cases from it on does even
    at the lower end of Wilson's interval, so that many sure cases do not carry a few doubtful ones with them.
    """
    pools: list[list] = []  # least score, positives, cases
    for score, p, k in sorted(scored, reverse=True):
        pools.append([score, p, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] <= pools[-1][1] * pools[-2][2]:
            least, p2, k2 = pools.pop()
            pools[-1] = [least, pools[-1][1] + p2, pools[-1][2] + k2]
    pos = n = 0
    best = 2.0
    for least, p, k in pools:
        if p < precision * k:
            break
        pos, n = pos + p, n + k
        share = pos / n
        low = (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if low >= precision:
            best = least
    return best
