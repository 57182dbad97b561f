"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores of the lower-cased text. A seed is three words of a test item that follow each other or have one word
between, on either side: a copy with every third word replaced, or a word put in after every second, has such seeds and no three words
in a row. All seeds of an item are probed, as an edited or partial copy may keep only the common ones. Where a seed occurs, the passage around
it, with as many words beside the item's as an alignment at the threshold can hold, is aligned with the item: matches give 2, other words and
gaps cost 1, and the score is the best local alignment's share of a perfect one. Edited and paraphrased copies keep most of it, unrelated passages do not. Passages that
common seeds lead to are left out before the alignment only if they have too few of the item's words for the threshold.

The items are sent to the tasks in groups whose number of seeds is bounded (``GROUP_SEEDS``); each group reads the documents
once, which joins them without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, named, staged

#: Places of a seed's words. At a share of one half, two words of three match, so that one of these survives any lone replacements.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Seeds, and with them words of items, that are sent to the tasks at once.
GROUP_SEEDS = 500_000
#: Words that the codes of seeds have room for.
_ROOM = 1 << 20
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Items:
    """A group of test items: the numbers of their words (0 is any other word) and their seeds by code."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    words: dict[int, np.ndarray] = field(default_factory=dict)
    #: An item's different words in order, and how often it holds each.
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        out = cls()
        for number, text in rows:
            ids = np.array([out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in tokens(text)], np.int64)
            out.words[number] = ids
            out.counts[number] = np.unique(ids, return_counts=True)
            at, codes = seeds_in(ids)
            for place, code in zip(at.tolist(), codes.tolist(), strict=True):
                out.places.setdefault(code, []).append((number, place))
        out.codes = np.array(sorted(out.places), np.int64)
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the group's seeds among a text's words."""
        at, codes = seeds_in(ids)
        if not len(at) or not len(self.codes):
            return at[:0], codes[:0]
        found = self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes
        return at[found], codes[found]


def seeds_in(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the seeds of known words, in order of place."""
    places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    known = ids > 0
    for x, y, z in SHAPES:
        n = len(ids) - z
        if n > 0:
            at = np.flatnonzero(known[x : x + n] & known[y : y + n] & known[z : z + n])
            places.append(at)
            codes.append((ids[at + x] * _ROOM + ids[at + y]) * _ROOM + ids[at + z])
    places, codes = np.concatenate(places), np.concatenate(codes)
    order = np.argsort(places, kind="stable")
    return places[order], codes[order]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment and the word of the passage behind it."""
    places = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + places) - places, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def may_reach(item: np.ndarray, passage: np.ndarray, threshold: float) -> bool:
    """Whether an alignment's share can be ``threshold``; false only where none is.

    Its score 2m - e from m matches and e other words is at least 2tn for n words of the item, so m is at least tn; e is at
    most 2n(1 - t), so the matches lie within n + 2n(1 - t) words of the passage.
    """
    n = len(item)
    length = max(n + int(2 * n * (1 - threshold)) + 1, 1)
    held = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
    most = min(n, int((held[length:] - held[:-length]).max())) if length < len(held) else min(n, int(held[-1]))
    return 2 * most / (2 * n) >= threshold


def dense_parts(words: np.ndarray, most: np.ndarray, passage: np.ndarray, threshold: float) -> list[list[int]]:
    """Ranges that hold every alignment at the threshold, by the counts of ``may_reach``; an item is its different words and their counts."""
    n = int(most.sum())
    at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
    hit = words[at] == passage

    def common(a: int, b: int) -> int:
        """How many words the item can match there at most: each as often as both hold it."""
        return int(np.minimum(most, np.bincount(at[a:b][hit[a:b]], minlength=len(words))).sum())

    if common(0, len(passage)) < threshold * n:
        return []
    length = max(n + int(2 * n * (1 - threshold)) + 1, 1)
    held = np.concatenate([[0], np.cumsum(hit)])
    if length >= len(held):
        return [[0, len(passage)]]
    starts = np.flatnonzero(held[length:] - held[:-length] >= threshold * n)
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length)
    firsts, lasts = starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)]
    ranges = [(int(a), int(b) + length) for a, b in zip(firsts, lasts, strict=True)]
    return [[a, b] for a, b in ranges if common(a, b) >= threshold * n]


def leaks_in(ids: np.ndarray, items: Items, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item, best score, first word, end, number of passages) of the items a text leaks."""
    at, codes = items.hits(ids)
    ranges: dict[int, list[tuple[int, int]]] = {}
    for place, code in zip(at.tolist(), codes.tolist(), strict=True):
        for number, offset in items.places[code]:
            length = len(items.words[number])
            slack = int(2 * length * (1 - threshold)) + 1
            ranges.setdefault(number, []).append((max(0, place - offset - slack), min(len(ids), place - offset + length + slack)))
    out = []
    for number, spans in ranges.items():
        item = items.words[number]
        found = []
        parts = [(low + a, low + b) for low, high in merged(spans) for a, b in dense_parts(*items.counts[number], ids[low:high], threshold)]
        for low, high in parts:
            score, end = align(item, ids[low:high])
            share = score / (2 * len(item))
            if share >= threshold:
                _, back = align(item[::-1], ids[low : low + end][::-1])
                found.append((share, low + end - back, low + end))
        if found:
            share, first, end = max(found, key=lambda x: (x[0], -x[1]))
            out.append((number, share, first, end, len(found)))
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Ids and texts of the items in groups of bounded size, read one group at a time."""
    rows = items.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).filter("id is not null and text is not null")
    rows = rows.distinct()
    size = F.greatest(F.size(F.split("text", r"\W+")), F.lit(1))
    total = rows.agg(F.sum(size)).first()[0] or 0
    groups = int(total // (GROUP_SEEDS // (2 * len(SHAPES)))) + 1
    for g in range(groups):
        found = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect() if total else []
        yield sorted((r["id"], r["text"]) for r in found)


def benchmark_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = 0.5, work: str | None = None,
) -> DataFrame:
    """Pairs of documents and test items that leaked into them: ``id_col, item_col, score, first_word, end_word, passages``.

    A copy is found if at least one seed of it is intact; no other copy is. One row per row of ``docs`` and item, with the best passage's score and words (numbered from 0, end exclusive) and the number of passages that
    reach ``threshold``. Null and empty texts and items, items of fewer than three words and items without an id match nothing;
    rows with a null document id are searched as others are; an item id with several texts is each of them. Without items
    the result is empty. Other columns are not read.
    """
    texts = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text")).filter("_text is not null")
    kind = docs.select(named(id_col)).dtypes[0][1]
    schema = f"_id {kind}, item long, score double, first long, `end` long, passages long"
    parts = [
        staged(map_batches(texts, _search(group, numbers, threshold), schema), "leaks", work)
        for group, numbers in _seeded_groups(items, item_col, item_text_col)
    ]
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.select(
        F.col("_id").alias(id_col), F.col("item").alias(item_col), "score", F.col("first").alias("first_word"),
        F.col("end").alias("end_word"), "passages",
    )


def drop_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """``docs`` without the documents that any item leaked into, by the same rules. No shuffle."""
    for group, _ in _seeded_groups(items, item_col, item_text_col):
        docs = docs.filter(~_leaked(group, threshold)(named(text_col)))
    return docs


def _leaked(group: Items, threshold: float):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(leaks_in(group.numbers(t), group, threshold)))

    return leaked


def _seeded_groups(items: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[Items, list[int]]]:
    """Each group of items with its seeds, and the items' ids."""
    for rows in _groups(items, item_col, item_text_col):
        if rows:
            group = Items.of([(at, text) for at, (_, text) in enumerate(rows)])
            if len(group.vocabulary) >= _ROOM:
                raise ValueError("a group of items has too many words; lower GROUP_SEEDS")
            yield group, [number for number, _ in rows]


def _search(group: Items, numbers: list[int], threshold: float):
    def search(batch):
        out: dict[str, list] = {n: [] for n in ("_id", "item", "score", "first", "end", "passages")}
        for i, text in zip(batch["_id"], batch["_text"], strict=True):
            for number, score, first, end, passages in leaks_in(group.numbers(text), group, threshold):
                for name, value in zip(out, (i, numbers[number], score, first, end, passages), strict=True):
                    out[name].append(value)
        return out

    return search
