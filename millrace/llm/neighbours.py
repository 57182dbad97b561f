"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations that are learned on a bounded sample (principal axes, then the rotation that
loses least by rounding to signs; several from different starts give longer codes). A code is split into substrings of 8
bits and each substring is an index of its own. Two codes within Hamming radius ``r`` must agree within
``floor(r / substrings)`` bits in one substring, and in all but the first ``r mod substrings + 1`` of them one bit less is
enough, so probing the nearby values of every substring retrieves every code within ``r``. Those are counted in full, then
reranked by inner product of the original vectors. The radius is chosen on the sample, by where its true neighbours lie.

Spark deals both sides in blocks: the index in blocks of ``block_rows`` vectors by hash, the query set in blocks of
``query_rows``; every task builds the substring indexes of one index block and searches it for one query block, so its
memory is bounded and a common vector or bucket stays in many blocks. Partial results meet in a top-k window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import named, staged

#: Differing bits of two bytes.
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


@dataclass
class HashIndex:
    """Maximum inner product becomes nearness of directions by one more component, ``sqrt(longest ** 2 - |x| ** 2)``."""

    mean: np.ndarray
    rotations: np.ndarray
    longest: float
    radius: int

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def encode(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        return np.packbits((widened(vectors, self.longest, query) - self.mean) @ self.rotations > 0, axis=1)


def widened(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit queries and a last component of 0; others scaled by the longest and their last component as above."""
    norms = np.linalg.norm(vectors, axis=1)
    scale = np.maximum(norms, 1e-300) if query else np.full(len(vectors), max(longest, 1e-300))
    x = vectors / scale[:, None]
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(1)))
    return np.concatenate([x, last[:, None]], 1)


def learn_rotations(x: np.ndarray, rounds: int, rng: np.random.Generator, iterations: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The mean and ``rounds`` learned rotations side by side, their width a multiple of 8."""
    mean = x.mean(0)
    centred = x - mean
    dim = x.shape[1]
    width = max(8, dim // 8 * 8)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = np.concatenate([axes, np.zeros((max(0, width - len(axes)), dim))])[:width].T
    lower = centred @ axes
    out = []
    for _ in range(rounds):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(iterations):
            left, _, right = np.linalg.svd(np.sign(lower @ turn).T @ lower)
            turn = (left @ right).T
        out.append(axes @ turn)
    return mean, np.concatenate(out, 1)


def fit_index(sample: np.ndarray, longest: float, k: int, rounds: int, recall: float, seed: int) -> HashIndex:
    """Learn codes on ``sample`` and the radius within which ``recall`` of its own ``k`` true neighbours lie.

    In the full set the true neighbours are nearer than in a part of it, so the radius holds there as well.
    """
    rng = np.random.default_rng(seed)
    mean, rotations = learn_rotations(widened(sample, longest, False), rounds, rng)
    index = HashIndex(mean, rotations, longest, rotations.shape[1])
    codes = index.encode(sample)
    asked = rng.permutation(len(sample))[:400]
    asked_codes = index.encode(sample[asked], query=True)
    apart = []
    for row, code in zip(asked, asked_codes, strict=True):
        near = sample @ sample[row]
        near[row] = -np.inf
        top = np.argpartition(-near, min(k, len(near) - 1))[:k] if len(near) > k else np.flatnonzero(np.isfinite(near))
        apart.extend(np.bitwise_count(codes[top] ^ code).sum(1))
    if apart:
        index.radius = int(np.quantile(apart, recall, method="higher"))
    return index


class SubstringTables:
    """For each substring and each value a query may have there, the rows of the block with a value near enough, as bits."""

    def __init__(self, codes: np.ndarray, radius: int) -> None:
        self.radius = radius
        self.words = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)
        tables = codes.shape[1]
        each, wider = divmod(radius, tables)
        self.near = [
            np.packbits((_APART <= reach)[:, codes[:, s]], axis=1)
            for s, reach in ((s, each if s <= wider else each - 1) for s in range(tables)) if reach >= 0
        ]

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """Of each query code, bits of the rows that are near in some substring."""
        out = np.zeros((len(codes), self.near[0].shape[1]), np.uint8)
        for s, near in enumerate(self.near):
            out |= near[codes[:, s]]
        return out

    def apart(self, code: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        word = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        return np.bitwise_count(self.words[rows] ^ word).sum(1)


def search_block(index: HashIndex, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, query_vectors: np.ndarray, k: int):
    """The ``k`` best of one index block for each query, its own row left out: (query, row, score) arrays.

    Where the radius holds fewer than ``k``, it is widened to that of the nearest ``k`` codes.
    """
    tables = SubstringTables(index.encode(vectors), index.radius)
    codes = index.encode(query_vectors, query=True)
    found = []
    for start in range(0, len(queries), 512):
        probed = tables.probe(codes[start : start + 512])
        for at in range(start, min(start + 512, len(queries))):
            rows = np.flatnonzero(np.unpackbits(probed[at - start], count=len(ids)))
            rows = rows[tables.apart(codes[at], rows) <= tables.radius]
            rows = rows[ids[rows] != queries[at]]
            if len(rows) < k:
                others = np.flatnonzero(ids != queries[at])
                apart = tables.apart(codes[at], others)
                if len(others) > k:
                    others = others[apart <= np.partition(apart, k - 1)[k - 1]]
                rows = others
            scores = (vectors[rows] * query_vectors[at]).sum(1)
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), queries[at]), ids[rows[best]], scores[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id`` and ``_vec`` (doubles) of the rows that take part."""
    rows = df.select(named(id_col).cast("long").alias("_id"), named(vector_col).cast("array<double>").alias("_vec"))
    usable = (
        F.col("_id").isNotNull() & (F.size("_vec") > 0)
        & F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("_vec", lambda x: x != 0)
    )
    return rows.filter(usable)


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = 4000, rounds: int = 4, recall: float = 0.97, block_rows: int = 16384, query_rows: int = 4096, seed: int = 11,
    work: str | None = None,
) -> DataFrame:
    """For each row of ``queries`` the ``k`` rows of ``vectors`` with the largest inner product, its own id left out.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id. Null ids, vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of another length than most take no part. Repeated ids count
    as rows of their own among ``vectors`` and are asked once. Every other row is indexed; codes are learned on at most
    ``sample_rows`` of them. With fewer than ``k`` candidates all are returned, with none no row.
    """
    rows = valid_vectors(vectors, id_col, vector_col)
    asked = valid_vectors(queries, id_col, vector_col)
    about = rows.groupBy(F.size("_vec").alias("dim")).agg(
        F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")
    ).orderBy(F.desc("n"), "dim").first()
    if about is None:
        return rows.select(
            F.col("_id").alias("query_id"), F.lit(1).alias("rank"), F.col("_id").alias("vec_id"), F.lit(0.0).alias("score")
        ).limit(0)
    rows, asked = (x.filter(F.size("_vec") == about["dim"]) for x in (rows, asked))
    order = F.xxhash64(F.lit(seed), "_id")
    sample = rows.orderBy(order, "_id").limit(sample_rows).select("_vec").collect()
    index = fit_index(np.array([r[0] for r in sample]), about["longest"], k, rounds, recall, seed)
    asked = staged(asked.dropDuplicates(["_id"]), "queries", work)
    blocks = max(1, math.ceil(about["n"] / block_rows))
    query_blocks = max(1, math.ceil(asked.count() / query_rows))
    spread = F.xxhash64("_id", "_vec")
    left = rows.withColumn("_block", F.pmod(spread, F.lit(blocks)).cast("int"))
    left = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("_part", F.pmod(spread, F.lit(query_blocks)).cast("int"))
    right = right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = search_block(
            index, own["_id"].to_numpy(), np.stack(own["_vec"]), other["_id"].to_numpy(), np.stack(other["_vec"]), k
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
