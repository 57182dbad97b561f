"""MinHash near-duplicates: an inverted join of signature coordinates, confirmed on full shingle sets.

A text's signature has ``coordinates`` values, the least of its shingles' hashes under as many hash functions. Two texts collide in a
coordinate with a probability that is their Jaccard similarity, so similar ones collide in ``matches`` coordinates at
least (``matches_for``: missing a pair at the threshold has a chance below 1e-5; above it, far less).

Equal word sequences are one class, and classes are posted under every (coordinate, value). A class's postings are ordered
from rare to common; a pair with ``matches`` collisions must meet in the first ``coordinates - matches + 1`` of both (prefix), so
the common lists are skipped wherever a class has enough rare ones. Lists are then used twice:

1. every class in a list is paired with the list's centre, the class whose values are the most common, so a list of any
   length costs its length; confirmed pairs are links and their components are found;
2. in lists that still hold several components, classes of different components are paired, as far as their sets allow the
   similarity: by their sizes, by how many of their shingles occur in another class of these lists at all, and how many of
   those in the list's centre; a pair is made in the first list that both are in. Groups of copies are one component by then, so they are not
   expanded into pairs, and texts that share a passage, but have much of their own, are not paired.

Pairs must collide in ``matches`` coordinates; those are confirmed by comparing the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, named, staged
from millrace.llm.graph import components

_MIX = np.uint64(0x9E3779B97F4A7C15)


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: what bytes do by themselves."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` neighbours."""
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _MIX + hashes[k : k + max(n, 0)]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return rolled ^ (rolled >> np.uint64(32))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles; of fewer words, the whole sequence is one."""
    return np.unique(run_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, (factors[:, None] * part + offsets[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def matches_for(coordinates: int, percent: int, missed: float = 1e-5) -> int:
    """The largest number of collisions that a pair at the threshold fails to have with a chance of at most ``missed``."""
    p, below, k = percent / 100, 0.0, 0
    while k < coordinates:
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > missed:
            break
        k += 1
    return max(k, 1)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, coordinates: int = 64,
    seed: int = 5, work: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept, text_key`` (hash of the text).

    Texts link if their sets of ``shingle_words``-word shingles have a Jaccard similarity of ``percent`` or more; lower-casing
    is that of A-Z, words lie between ASCII white space, fewer words than a shingle are one shingle. ``component_id`` is the
    least id reachable over links, ``kept`` marks the rows that have it. A text without words has no shingles and no
    links: its component is its own id. Rows with a null id link as others do; null is never the least unless all ids of a
    component are, and then all of its rows are kept. Rows sharing the least id are all kept. Other columns are not read.
    """
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    matches = matches_for(coordinates, percent)

    def sign(batch):
        out = {"_id": batch["_id"], "text_key": batch["text_key"], "_hi": [], "_lo": [], "n": [], "sig": []}
        for text in batch["_text"]:
            hashes = word_hashes(lower_words(text))
            shingles = shingle_set(hashes, shingle_words)
            hi, lo = _digest(hashes)
            out["_hi"].append(hi)
            out["_lo"].append(lo)
            out["n"].append(len(shingles))
            out["sig"].append(signature(shingles, factors, offsets) if len(shingles) else None)
        return out

    texts = docs.select(named(id_col).cast("long").alias("_id"), named(text_col).alias("_text"))
    keyed = texts.withColumn("text_key", F.xxhash64("_text"))
    rows = map_batches(keyed, sign, "_id long, text_key long, _hi long, _lo long, n long, sig array<int>")
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "signed", work)
    classes = rows.filter("n > 0").groupBy("_hi", "_lo").agg(
        F.min("_row").alias("node"), F.min("_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    classes = staged(classes, "classes", work)
    lists = staged(_prefixes(classes, coordinates, matches), "postings", work)

    centre = F.max_by("node", F.struct("common", F.col("node")))
    centres = lists.groupBy("key").agg(centre.alias("centre"), F.count("*").alias("size")).filter("size > 1")
    stars = lists.join(centres, "key").filter("node <> centre")
    stars = stars.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    stars = staged(_collided(stars, classes, matches), "stars", work)
    sets = staged(_sets(_ends(stars), classes, texts, shingle_words), "star-sets", work)
    measured = staged(_measured(stars, sets), "star-measures", work)
    links = _similar(measured, percent)
    found = staged(components(links, work), "star-components", work)

    owned = lists.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = owned.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    owned = staged(owned.join(mixed, "key", "left_semi").select("key", "node", "n", "root"), "mixed-lists", work)
    sets = staged(_sets(owned.select("node").distinct(), classes, texts, shingle_words), "sets", work)
    able = F.col("shared") * 100 >= F.col("n") * percent
    owned = owned.join(_shared_shingles(sets), "node").filter(able).join(centres.select("key", "centre"), "key")
    toward = measured.select(F.col("a").alias("node"), F.col("b").alias("centre"), "common")
    toward = toward.unionByName(measured.select(F.col("b").alias("node"), F.col("a").alias("centre"), "common"))
    owned = owned.join(toward, ["node", "centre"], "left").withColumn("common", F.when(F.expr("node = centre"), F.col("n")).otherwise(F.col("common")))
    own_keys = owned.groupBy("node").agg(F.collect_list("key").alias("keys"))
    owned = staged(owned.join(own_keys, "node").join(classes.select("node", "sig"), "node"), "able-lists", work)
    # Two sets share what both share with the centre at most, and of the rest what either shares with any.
    beyond = F.least(F.col("x.shared") - F.col("x.common"), F.col("y.shared") - F.col("y.common"))
    known = F.col("x.common").isNotNull() & F.col("y.common").isNotNull()
    most = F.when(known, F.least("x.common", "y.common") + beyond).otherwise(F.least("x.shared", "y.shared"))
    fits = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    fits = fits & (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent)
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & fits & first
    met = met & (_agreeing("x.sig", "y.sig") >= matches)
    other = owned.alias("x").join(owned.alias("y"), met)
    pairs = other.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    more = staged(_similar(_measured(pairs, sets), percent), "links", work)
    found = staged(components(links.unionByName(more), work), "components", work)

    owned = classes.select("_hi", "_lo", "node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    owned = owned.join(lowest, "root").select("_hi", "_lo", "component_id")
    out = rows.drop("sig", "_row").join(owned, ["_hi", "_lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"),
        "text_key",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the least id; options as above.

    Rows equal in id and text stay once, and so do texts without words. Of rows that share an id, but not a text, each stays or goes
    with its own group.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.filter("kept").select(named(id_col).alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64(named(text_col)))
    match = named(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_text_key") == F.col("_kept_key"))
    return keyed.join(kept, match, "left_semi").dropDuplicates([id_col, "_text_key"]).drop("_text_key")


def _prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``key, node, n, common``: each class under those of its ``coordinates - matches + 1`` rarest postings that others
    share; ``common`` is the length of all of its lists."""
    value = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(value)
    posted = classes.select("node", "n", F.posexplode("sig").alias("at", "value")).select("node", "n", key.alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    grouped = posted.join(shared, "key").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("size", "key"))).alias("lists"), F.sum("size").alias("common")
    )
    rare = F.lit(coordinates) - F.size("lists")
    room = F.greatest(F.lit(coordinates - matches + 1) - rare, F.lit(0))
    return grouped.select("node", "n", "common", F.explode(F.slice("lists", F.lit(1), room)).alias("x")).select(
        "x.key", "node", "n", "common"
    )


def _collided(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Those pairs of classes whose signatures agree in ``matches`` coordinates."""
    signed = classes.select("node", "sig")

    def side(s: str) -> DataFrame:
        return signed.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_agreeing("sig_a", "sig_b") >= matches).select("a", "b")


def _agreeing(one: str, other: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda e: e))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``node, set`` of those classes, from one text of each; its digest tells whether a row of its id is the one."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("least").alias("_of"), "_hi", "_lo")

    def sets(batch):
        out = {"node": [], "set": []}
        for node, hi, lo, text in zip(batch["node"], batch["_hi"], batch["_lo"], batch["_text"], strict=True):
            hashes = word_hashes(lower_words(text))
            if _digest(hashes) == (hi, lo):
                out["node"].append(node)
                out["set"].append(shingle_set(hashes, size).view(np.int64))
        return out

    read = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_of"))).select("node", "_hi", "_lo", "_text")
    return map_batches(read, sets, "node long, set array<long>").dropDuplicates(["node"])


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """``node, shared``: how many shingles of a set are in another one."""
    each = sets.select("node", F.explode("set").alias("shingle"))
    others = each.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1").select("shingle")
    return each.join(others, "shingle").groupBy("node").agg(F.count("*").alias("shared"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``, the sizes of their sets and how many shingles they have in ``common``."""

    def side(s: str) -> DataFrame:
        return sets.select(F.col("node").alias(s), F.col("set").alias(f"set_{s}"))

    common = F.size(F.array_intersect("set_a", "set_b")).alias("common")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), common)


def _similar(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(F.expr(f"common * 100 >= (n_a + n_b - common) * {percent}")).select("a", "b")
