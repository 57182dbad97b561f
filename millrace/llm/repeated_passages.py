"""Substring deduplication by repeated-phrase automata.

A passage repeats if a window of ``window`` words of a document also starts in a document with a smaller id.

1. Recurring windows. Equal windows have equal runs of ``GRAM`` words, so each window is filed under the run with the least
   hash in it (about one run in twenty). Only windows whose run occurs in two documents are hashed and counted; the
   owner of a window that recurs is its first place in the smallest document. Equal texts are settled before: only the smallest
   id of each takes part.
2. Automata. What an owner owns is cut into pieces of ``PIECE`` words; every piece gives its phrases of ``window // 2``
   words, end to end, so that any window in it holds a whole phrase. Pieces are dealt to shards of a fixed number of words, each
   shard compiled into an Aho-Corasick automaton.
3. Every stretch of a document whose windows are owned elsewhere is streamed through the automata of the pieces that own
   them. A phrase found is extended in both directions, word by word, over piece and text; runs of a window and more are
   covered. A shard with much to read is repeated and its stretches are dealt among the copies.

The texts are written once, bucketed by id and hash, so that what the steps find joins them without moving them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import delete_at_exit, map_batches, named, staged
from millrace.llm.near_duplicates import run_hashes, word_hashes
from millrace.session import scratch_path

GRAM = 8
#: Words of a piece and of the automata of a shard, and words of text that one copy of a shard reads.
PIECE, SHARD_WORDS, STREAM_WORDS = 4000, 40_000, 300_000


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_grams(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``gram`` words, and for each window the run it is filed under: the first of the least hash."""
    grams = run_hashes(hashes, gram)
    span = window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    # Least of every span by doubling: spans of a power of two, then two that overlap.
    at = np.arange(len(grams))
    size = 1
    while size * 2 <= span:
        left, right = at[: len(at) - size], at[size:]
        at = np.where(grams[left] <= grams[right], left, right)
        size *= 2
    left, right = at[:n], at[span - size : span - size + n]
    return grams, np.where(grams[left] <= grams[right], left, right)


def stretches(starts: list[int], keys: list, window: int) -> Iterator[tuple[object, int, int]]:
    """Runs of neighbouring window starts with the same key, as (key, first word, end)."""
    first = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] != starts[i - 1] + 1 or keys[i] != keys[first]:
            yield keys[first], starts[first], starts[i - 1] + window
            first = i


class PhraseAutomaton:
    """Pieces of text and the automaton of their phrases."""

    def __init__(self, window: int) -> None:
        self.window, self.step = window, window // 2
        self.pieces: list[list[str]] = []
        self.automaton = ahocorasick.Automaton()

    def add(self, text: str) -> None:
        words = text.split(" ")
        number = len(self.pieces)
        self.pieces.append(words)
        for at in range(0, len(words) - self.step + 1, self.step):
            phrase = " " + " ".join(words[at : at + self.step]) + " "
            if phrase in self.automaton:
                self.automaton.get(phrase).append((number, at))
            else:
                self.automaton.add_word(phrase, [(number, at)])

    def compile(self) -> None:
        if len(self.automaton):
            self.automaton.make_automaton()

    def covered(self, text: str) -> list[tuple[int, int]]:
        """Runs of words of ``text`` that repeat a window and more of a piece."""
        if not len(self.automaton):
            return []
        words = text.split(" ")
        places = np.cumsum([0] + [len(w) + 1 for w in words])
        done: dict[tuple[int, int], int] = {}
        out = []
        for last, found in self.automaton.iter(f" {text} "):
            end = int(np.searchsorted(places, last))
            for number, at in found:
                piece, start = self.pieces[number], end - self.step
                line = (number, start - at)
                if done.get(line, -1) >= end:
                    continue
                low = 0
                while low < min(start, at) and words[start - 1 - low] == piece[at - 1 - low]:
                    low += 1
                high, behind = 0, at + self.step
                while end + high < len(words) and behind + high < len(piece) and words[end + high] == piece[behind + high]:
                    high += 1
                done[line] = end + high
                if low + self.step + high >= self.window:
                    out.append((start - low, end + high))
        return out


def _bucketed(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``_id, _key, _text``, written in buckets by both, which all later joins use; the key tells rows of one id apart."""
    spark = docs.sparkSession
    name, path = f"passages_{uuid.uuid4().hex}", scratch_path(spark, "passages")
    rows = docs.select(
        named(id_col).cast("long").alias("_id"), F.xxhash64(named(text_col)).alias("_key"), named(text_col).alias("_text")
    )
    rows.repartition(buckets, "_id", "_key").write.bucketBy(buckets, "_id", "_key").option("path", path).saveAsTable(name)
    delete_at_exit(spark, path)
    return spark.table(name)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, work: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, spans, kept`` with the spans of words that repeat and the text without them.

    Words lie between ASCII white space and are compared as they are. ``spans`` are structs of first word and end, merged
    and in order; ``kept`` joins the other words by one space. A null id is neither smaller nor larger than any: such rows stay
    whole and are no source, and so do null and empty texts and texts shorter than the window. Rows that share an id are
    no sources for each other. Other columns are not read.
    """
    if window < 2 * GRAM:
        raise ValueError(f"a window has {2 * GRAM} words at least")
    spark = docs.sparkSession
    texts = _bucketed(docs, id_col, text_col, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lead = texts.filter("_id is not null and _text is not null").select("_id", "_key", F.md5("_text").alias("_md5"))
    lead = lead.groupBy("_md5").agg(F.min(F.struct("_id", "_key")).alias("x")).select("x.*").distinct()
    lead = staged(lead, "leaders", work)
    leaders = texts.join(lead, ["_id", "_key"], "left_semi")

    def grams(batch):
        out = {"_id": [], "_key": [], "gram": [], "at": []}
        for i, key, text in zip(batch["_id"], batch["_key"], batch["_text"], strict=True):
            hashes, at = window_grams(word_hashes(split_words(text)), window, GRAM)
            at = np.unique(at)
            out["gram"].extend(hashes[at].view(np.int64).tolist())
            out["at"].extend(at.tolist())
            out["_id"].extend([i] * len(at))
            out["_key"].extend([key] * len(at))
        return out

    filed = staged(map_batches(leaders, grams, "_id long, _key long, gram long, at int"), "grams", work)
    common = filed.groupBy("gram").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).filter("low < high").select("gram")
    wanted = filed.join(common, "gram", "left_semi").groupBy("_id", "_key").agg(F.collect_set("at").alias("places"))

    def windows(batch):
        out = {"_id": [], "_key": [], "window": [], "start": []}
        for i, key, text, places in zip(batch["_id"], batch["_key"], batch["_text"], batch["places"], strict=True):
            hashes = word_hashes(split_words(text))
            _, at = window_grams(hashes, window, GRAM)
            starts = np.flatnonzero(np.isin(at, np.array(places)))
            out["window"].extend(run_hashes(hashes, window)[starts].view(np.int64).tolist())
            out["start"].extend(starts.tolist())
            out["_id"].extend([i] * len(starts))
            out["_key"].extend([key] * len(starts))
        return out

    hashed = map_batches(texts.join(wanted, ["_id", "_key"]), windows, "_id long, _key long, window long, start int")
    hashed = staged(hashed, "windows", work)
    owners = hashed.groupBy("window").agg(F.min(F.struct("_id", "start", "_key")).alias("o"), F.max("_id").alias("high"))
    owners = owners.filter("o._id < high").select("window", "o")
    owned = hashed.join(owners, "window").select(
        "_id", "_key", "start", F.col("o._id").alias("owner"), F.floor(F.col("o.start") / PIECE).cast("int").alias("piece"),
        ((F.col("_id") == F.col("o._id")) & (F.col("start") == F.col("o.start")) & (F.col("_key") == F.col("o._key"))).alias("own"),
    ).filter("own or _id > owner")
    places = owned.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct("own", "start", "owner", "piece"))).alias("places"))

    def cut(batch):
        out = {"_id": [], "_key": [], "owner": [], "piece": [], "own": [], "first": [], "words": [], "part": []}
        for i, key, text, found in zip(batch["_id"], batch["_key"], batch["_text"], batch["places"], strict=True):
            words = split_words(text)
            for own in (True, False):
                chosen = [p for p in found if p["own"] == own]
                for (owner, piece), first, end in stretches([p["start"] for p in chosen], [(p["owner"], p["piece"]) for p in chosen], window):
                    out["_id"].append(i)
                    out["_key"].append(key)
                    out["owner"].append(owner)
                    out["piece"].append(piece)
                    out["own"].append(own)
                    out["first"].append(first)
                    out["words"].append(end - first)
                    out["part"].append(b" ".join(words[first:end]).decode("utf-8", "surrogatepass"))
        return out

    parts = map_batches(
        texts.join(places, ["_id", "_key"]), cut,
        "_id long, _key long, owner long, piece int, own boolean, first int, words int, part string",
    )
    parts = staged(parts, "parts", work)
    spans = staged(_located(parts, window), "spans", work)
    return _without(texts, lead, spans, id_col, window)


def _located(parts: DataFrame, window: int) -> DataFrame:
    """``_id, _key, first, end``: what the automata find in the stretches."""
    sums = parts.agg(F.sum(F.when(F.col("own"), F.col("words"))).alias("own")).first()
    shards = int((sums["own"] or 0) // SHARD_WORDS) + 1
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("owner", "piece"), F.lit(shards)).cast("int"))
    copies = dealt.groupBy("shard").agg(
        (F.floor(F.sum(F.when(~F.col("own"), F.col("words")).otherwise(0)) / STREAM_WORDS) + 1).cast("int").alias("copies")
    )
    dealt = dealt.join(copies, "shard")
    every = F.sequence(F.lit(0), F.col("copies") - 1)
    one = F.array(F.pmod(F.xxhash64("_id", "first"), F.col("copies")).cast("int"))
    dealt = dealt.withColumn("copy", F.explode(F.when(F.col("own"), every).otherwise(one))).drop("copies")
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", F.desc("own"), "_id", "first")
    columns = dealt.select("shard", "copy", "own", "_id", "_key", "first", "part")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_key", "first", "end"]
        now, reading, found = None, False, PhraseAutomaton(window)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            rows = batch.to_pydict()
            for shard, copy, own, i, key, first, part in zip(*[rows[c] for c in batch.schema.names], strict=True):
                if (shard, copy) != now:
                    now, reading, found = (shard, copy), False, PhraseAutomaton(window)
                if own:
                    found.add(part)
                    continue
                if not reading:
                    found.compile()
                    reading = True
                for low, high in found.covered(part):
                    for name, value in zip(names, (i, key, first + low, first + high), strict=True):
                        out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return columns.mapInArrow(stream, "_id long, _key long, first int, end int")


def _without(texts: DataFrame, lead: DataFrame, spans: DataFrame, id_col: str, window: int) -> DataFrame:
    """The texts without the words in the spans, and without all words where an equal text has a smaller id."""
    merged = spans.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))
    marked = texts.join(lead.withColumn("_lead", F.lit(True)), ["_id", "_key"], "left").join(merged, ["_id", "_key"], "left")
    marked = marked.withColumn("_copy", F.col("_id").isNotNull() & F.col("_text").isNotNull() & F.col("_lead").isNull())

    def remove(batch):
        out = {"_id": batch["_id"], "n_words": [], "spans": [], "kept": []}
        for text, copy, found in zip(batch["_text"], batch["_copy"], batch["spans"], strict=True):
            words = split_words(text)
            runs: list[list[int]] = []
            for first, end in [(0, len(words))] if copy and len(words) >= window else [(s["first"], s["end"]) for s in found or []]:
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([first, end])
            kept, at = [], 0
            for first, end in runs:
                kept += words[at:first]
                at = end
            kept += words[at:]
            out["n_words"].append(len(words))
            out["spans"].append(runs)
            out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return out

    result = map_batches(
        marked.select("_id", "_text", "_copy", "spans"), remove, "_id long, n_words long, spans array<array<int>>, kept string"
    )
    return result.select(
        F.col("_id").alias(id_col), "n_words",
        F.transform("spans", lambda s: F.struct(F.get(s, F.lit(0)).alias("first"), F.get(s, F.lit(1)).alias("end"))).alias("spans"), "kept",
    )
