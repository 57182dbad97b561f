"""Repair of the structure of conversations by block tables (the method of the four Russians).

A conversation should open with at most one system row and go on with pairs of a user's and an assistant's. What it takes to get there from
each state (nothing yet, after the system, a user's or an assistant's row) is a vector of four costs. Less its first entry, only some twenty
vectors exist, so that the way a vector changes over a block of rows is a number per (vector, block), worked out once for all blocks of a
fixed length. Conversations are read block by block from their end by looking these up; then each block is expanded backward, from the vector
behind it to those between its rows, and its edits chosen forward, the least letter among those that keep the cost least.

A conversation may hold any share of all rows. Rows are put in order by one range shuffle that splits conversations, and cut into pieces of a
bounded size. A piece maps the vector behind it to the one before it, and the state before it to the one behind it, so that pieces of one
conversation are joined by their maps alone. Where an operator must give one value for a whole conversation (a digest), it streams.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import named, staged, to_arrow

WHITE = " \t\n\x0b\x0c\r"
#: States, and where a user's or an assistant's row leads from each; a row may be kept where its role's initial allows.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
INITIALS = "sua"
#: Symbols of rows: twice the initial's number (3 for any other), one more if truncated; rows that must go; no row at all.
MUST_GO, NO_ROW, SYMBOLS = 8, 9, 10
#: Rows of a piece; a power of two.
PIECE_ROWS = 1 << 16


@dataclass(frozen=True)
class Costs:
    """What edits cost; a truncated row that stays costs ``truncated`` more."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class BlockTables:
    """All vectors, and the vector before each block of ``length`` rows for each vector behind it."""

    def __init__(self, costs: Costs = Costs(), length: int = 4):
        self.costs, self.length = costs, length

    def _with_inserts(self, vector: list) -> tuple:
        for _ in range(3):
            vector = [min(v, self.costs.insert + vector[NEXT[s]]) for s, v in enumerate(vector)]
        return tuple(vector)

    def _kept(self, symbol: int, state: int) -> tuple[int | None, int]:
        """The state a kept row leads to, if it may be kept, and what it costs to leave it in the conversation."""
        initial, cut = divmod(symbol, 2)
        return KEPT[initial].get(state), cut * self.costs.truncated

    def before(self, vector: tuple, symbol: int) -> tuple:
        """Least cost from each state on, one row earlier."""
        if symbol == NO_ROW:
            return vector
        out = []
        for state in range(4):
            options = [self.costs.delete + vector[state]]
            if symbol != MUST_GO:
                to, cut = self._kept(symbol, state)
                options += [self.costs.rerole + cut + vector[NEXT[state]]] + ([cut + vector[to]] if to is not None else [])
            out.append(min(options))
        return self._with_inserts(out)

    @cached_property
    def vectors(self) -> list[tuple]:
        """Every vector that can occur, less its first entry; the one behind the last row is the first."""
        found = [self._with_inserts([0, math.inf, math.inf, 0])]
        for vector in found:
            for symbol in range(SYMBOLS):
                earlier = self.before(vector, symbol)
                earlier = tuple(v - earlier[0] for v in earlier)
                if earlier not in found:
                    found.append(earlier)
        return found

    @cached_property
    def blocks(self) -> np.ndarray:
        """Number of the vector before a block by number of the vector behind it and block; a block's symbols are the digits of its number."""
        number = {v: i for i, v in enumerate(self.vectors)}
        step = np.empty((len(number), SYMBOLS), np.int16)
        for vector, i in number.items():
            for symbol in range(SYMBOLS):
                earlier = self.before(vector, symbol)
                step[i, symbol] = number[tuple(v - earlier[0] for v in earlier)]
        out = np.arange(len(number), dtype=np.int16)[:, None]
        for _ in range(self.length):
            out = np.concatenate([step[out, symbol] for symbol in range(SYMBOLS)], axis=1)
        return out

    def codes(self, symbols: str) -> list[int]:
        """Blocks of a string of symbols, filled up behind with no rows."""
        padded = symbols + str(NO_ROW) * (-len(symbols) % self.length)
        return [int(padded[i : i + self.length]) for i in range(0, len(padded), self.length)]

    def vector_map(self, symbols: str) -> np.ndarray:
        """Number of the vector before the rows for each one behind them."""
        at = np.arange(len(self.vectors))
        for code in reversed(self.codes(symbols)):
            at = self.blocks[at, code]
        return at

    def trace(self, symbols: str, behind: int, state: int) -> tuple[int, list[str]]:
        """State behind the rows and the steps at each, coming in ``state``, with vector ``behind`` behind them.

        Steps are letters: ``u`` and ``a`` for inserted rows, then what happens to the row: ``D`` deleted, ``K`` kept, ``U`` and ``A`` given
        to the user or assistant.
        """
        codes = self.codes(symbols)
        vectors = [0] * len(codes)
        for k in range(len(codes) - 1, -1, -1):
            vectors[k], behind = behind, self.blocks[behind, codes[k]]
        steps: list[str] = []
        for vector, code in zip(vectors, codes, strict=True):
            state, letters = self.expanded(int(vector), code, state)
            steps += letters
        return state, steps[: len(symbols)]

    @cached_property
    def expanded(self):
        return lru_cache(1 << 16)(self._expanded)

    def _expanded(self, behind: int, code: int, state: int) -> tuple[int, tuple[str, ...]]:
        """One block: the vectors between its rows from the last to the first, then the least letters from the first to the last."""
        symbols = [int(c) for c in f"{code:0{self.length}d}"]
        vectors = [self.vectors[behind]]
        for symbol in reversed(symbols):
            vectors.insert(0, self.before(vectors[0], symbol))
        out = []
        for symbol, here, after in zip(symbols, vectors, vectors[1:], strict=False):
            letters = ""
            while symbol != NO_ROW:
                left, to = here[state], NEXT[state]
                if self.costs.delete + after[state] == left:
                    letters += "D"
                    break
                if self.costs.insert + here[to] == left:
                    letters, state = letters + "xxua"[to], to
                    continue
                kept, cut = self._kept(symbol, state)
                if kept is not None and cut + after[kept] == left:
                    letters, state = letters + "K", kept
                else:
                    letters, state = letters + "xxUA"[to], to
                break
            out.append(letters)
        return state, tuple(out)


def damage_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows with known faults: by crc32 of ``conversation:turn`` modulo 20 a row goes (0), loses its text (1) or its ``.!?`` (2), comes
    twice (3) or becomes the user's (4). Nulls are one space, but for the ids and turns themselves. Returns ``conv_id, turn, role, text``.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(named(conv_col).cast("string"), space), F.lit(":"), F.coalesce(named(turn_col).cast("string"), space))
    h = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(named(role_col), space), F.coalesce(named(text_col), space)
    rows = conversations.select(
        named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), h.alias("_h"),
    )
    copies = F.sequence(F.lit(1), F.when(F.col("_h") == 3, 2).otherwise(1))
    return rows.filter("_h != 0").select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def _in_order(rows: DataFrame, work: str | None) -> DataFrame:
    """The rows by conversation, turn, role and digest of the text, written with their place ``place`` in that order.

    Equal rows are told apart by a number, so that any number of them can be cut over several ranges.
    """
    keys = ["conv_id", "turn", "role", "_digest", "_number"]
    keyed = rows.withColumns({"_digest": F.sha2(F.col("text").cast("binary"), 256), "_number": F.monotonically_increasing_id()})
    order = [F.col(k).asc_nulls_first() for k in keys]
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(sorted_rows.drop("_number").withColumn("place", F.monotonically_increasing_id()), "repair-rows", work)


def _symbols(rows: DataFrame, costs: Costs) -> DataFrame:
    """``conv_id, place, fault, initial, symbol`` of every row."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = rows.select(
        "conv_id", "place", "role", "_digest", (end == "").alias("_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_cut"),
        F.substring("role", 1, 1).alias("initial"),
    )
    # Copies of one text are merged before the shuffle; places are unique, so the join back has no hot key.
    firsts = marked.groupBy("conv_id", "role", "_digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    found = marked.join(firsts, "place", "left").select("conv_id", "place", fault.alias("fault"), "initial")
    initial = F.lit(len(INITIALS))
    for i, c in enumerate(INITIALS):
        initial = F.when(F.col("initial") == c, i).otherwise(initial)
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    symbol = F.when(gone, MUST_GO).otherwise(2 * initial + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))
    return found.withColumn("symbol", symbol)


def _pieces(rows: DataFrame, value: Column) -> DataFrame:
    """``conv_id, piece, joined, only, last``: rows of a conversation, at most ``PIECE_ROWS`` at a time, ``value`` of each as one character
    of a string. A piece is named by its first place; the flags tell a conversation's only and last piece."""
    cut = rows.select("conv_id", "place", value.alias("_value"), F.floor(F.col("place") / PIECE_ROWS).alias("_cut"))
    in_order = F.array_sort(F.collect_list(F.struct("place", "_value")))
    pieces = cut.groupBy("conv_id", "_cut").agg(F.min("place").alias("piece"), in_order.alias("_rows"))
    all_of_it = Window.partitionBy("conv_id")
    return pieces.select(
        "conv_id", "piece", F.array_join("_rows._value", "").alias("joined"), (F.count("*").over(all_of_it) == 1).alias("only"),
        (F.max("piece").over(all_of_it) == F.col("piece")).alias("last"),
    )


def _mapped(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``function`` turns rows as dicts into rows as tuples of ``schema``."""
    fields = [(f.name, to_arrow(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [out for row in batch.to_pylist() for out in function(row)]
            columns = list(zip(*made, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    costs: Costs = Costs(), block_rows: int = 4, work: str | None = None,
) -> DataFrame:
    """Every row with its first fault and the cheapest edits that put its conversation right.

    Returns ``conv_id, turn, role, text, place, fault, steps``. Rows of a conversation are in order of turn (nulls first), role and digest of the
    text; ``place`` rises in that order. Faults are ``blank`` (nothing but white space), ``duplicate`` (role and text of an earlier row), ``truncated``
    (ends in none of ``.!?``), else null. The letters of ``steps`` are inserted rows of the user (``u``) and assistant (``a``), then what
    becomes of the row itself (``D`` deleted, ``K`` kept, ``U`` or ``A`` given to the user or assistant), and after the last row of a conversation
    those inserted at its end. Blank and duplicate rows are always deleted. Of equally cheap edits those are taken that read first in ASCII order
    as D, I (insert), K, R (new role).

    Null roles and texts are one space, so blank; a null id is a conversation of its own; repeated rows are duplicates; other columns are not read;
    no rows give no rows. The digest and the pieces hold nothing of unbounded size.
    """
    space = F.lit(" ")
    rows = rows.select(
        named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), F.coalesce(named(role_col), space).alias("role"),
        F.coalesce(named(text_col), space).alias("text"),
    )
    rows = _in_order(rows, work)
    marked = staged(_symbols(rows, costs), "repair-symbols", work)
    pieces = staged(_pieces(marked, F.col("symbol").cast("string")).withColumnRenamed("joined", "symbols"), "repair-pieces", work)
    tables = BlockTables(costs, block_rows)
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    long, number = T.LongType(), T.IntegerType()

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([conv, *(T.StructField(*f) for f in fields)])

    # Conversations in several pieces: the vector behind each piece, from the last to the first.
    several = pieces.filter("not only")
    maps = _mapped(
        several, lambda r: [(r["conv_id"], r["piece"], tables.vector_map(r["symbols"]).tolist())],
        schema(("piece", long), ("to", T.ArrayType(number))),
    )

    def from_the_last(group: pd.DataFrame) -> pd.DataFrame:
        group, at, out = group.sort_values("piece", ascending=False), 0, []
        for to in group["to"]:
            out.append(at)
            at = to[at]
        return pd.DataFrame({"piece": group["piece"], "behind": out})

    behind = maps.groupBy("conv_id").applyInPandas(from_the_last, "piece long, behind int")
    pieces = pieces.join(behind, "piece", "left").withColumn("behind", F.coalesce("behind", F.lit(0)))

    def traced(row: dict) -> list[tuple]:
        out = []
        for state in (START,) if row["only"] else range(4):
            left, steps = tables.trace(row["symbols"], row["behind"], state)
            if row["last"]:
                steps[-1] += {SYSTEM: "ua", USER: "a"}.get(left, "")
            out.append((row["conv_id"], row["piece"], row["only"], state, left, steps))
        return out

    traces = staged(_mapped(pieces, traced, schema(
        ("piece", long), ("only", T.BooleanType()), ("state", number), ("left", number), ("steps", T.ArrayType(T.StringType())),
    )), "repair-steps", work)

    def from_the_first(group: pd.DataFrame) -> pd.DataFrame:
        left = {(p, s): x for p, s, x in zip(group["piece"], group["state"], group["left"], strict=True)}
        at, out = START, []
        for piece in sorted(set(group["piece"])):
            out.append((piece, at))
            at = left[piece, at]
        return pd.DataFrame(out, columns=["piece", "state"])

    entered = traces.filter("not only").select("conv_id", "piece", "state", "left")
    entered = entered.groupBy("conv_id").applyInPandas(from_the_first, "piece long, state int")
    chosen = traces.filter("only").select("piece", "steps").unionByName(traces.join(entered, ["piece", "state"]).select("piece", "steps"))
    steps = chosen.select("piece", F.posexplode("steps").alias("_i", "steps")).select((F.col("piece") + F.col("_i")).alias("place"), "steps")
    edits = marked.select("place", "fault").join(steps, "place")
    return rows.join(edits, "place").select("conv_id", "turn", "role", "text", "place", "fault", "steps")


def repaired_rows(found: DataFrame) -> DataFrame:
    """The conversations put right: ``conv_id, place, part, role, text`` in order of place and part; inserted rows have empty text."""
    return found.select("conv_id", "place", F.posexplode(_lines()).alias("part", "_line")).select(
        "conv_id", "place", "part", "_line.role", "_line.text"
    )


def _lines() -> Column:
    """What a row's steps leave: role and text of each row."""

    def line(c: Column) -> Column:
        role = F.when(c == "K", F.col("role")).when(F.lower(c) == "u", "user").otherwise("assistant")
        return F.struct(role.alias("role"), F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    return F.transform(F.filter(F.split("steps", ""), lambda c: c.isin("u", "a", "U", "A", "K")), line)


def conversation_report(found: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", costs: Costs = Costs()) -> DataFrame:
    """One row per id of ``conversations``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gaps`` are turns missing between the least and the largest, nulls aside; ``illegal`` neighbours whose roles' initials do not go from
    system to user or between user and assistant. ``audit`` has one letter per edit, ``repaired_sha256`` is the digest of the repaired
    ``role:text`` lines. Ids without rows have zeros and the digest of empty text. Audit and digest are single values of a whole conversation,
    so its rows are streamed through one task in order, of which it holds a batch of rows and the letters, not the texts.
    """
    count = lambda rule: F.sum(rule.cast("long"))
    cost = (
        costs.insert * F.length(F.translate("steps", "DKUA", "")) + costs.rerole * F.length(F.translate("steps", "DKua", ""))
        + costs.delete * F.length(F.translate("steps", "UAKua", ""))
        + F.when((F.col("fault") == "truncated") & ~F.col("steps").contains("D"), costs.truncated).otherwise(0)
    )
    numbers = found.groupBy("conv_id").agg(
        (F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.sum(cost).cast("long").alias("cost"),
    )
    initial = F.substring("role", 1, 1)
    pieces = _pieces(found, F.when(initial.isin(*INITIALS), initial).otherwise("-"))
    before = F.lag(F.right("joined", F.lit(1))).over(Window.partitionBy("conv_id").orderBy("piece"))
    row = F.concat(F.coalesce(before, F.lit("")), F.col("joined"))
    illegal = F.length(row) - 1 - F.regexp_count(row, F.lit("(?=su|ua|au)"))
    neighbours = pieces.select("conv_id", illegal.alias("_illegal")).groupBy("conv_id").agg(F.sum("_illegal").cast("long").alias("illegal"))
    ids = conversations.select(named(conv_col).alias("conv_id"))
    parts = [ids, numbers, neighbours, _digests(found)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in zeros], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _digests(found: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``, streamed over the rows in order."""
    lines = F.transform(_lines(), lambda x: F.concat_ws(":", x["role"], x["text"]))
    rows = found.select(
        "conv_id", "place", F.translate("steps", "uaUA", "IIRR").alias("audit"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place").drop("place")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    types = [to_arrow(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, empty, done = None, None, None, True, []

        def written() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            for row in batch.to_pylist():
                if audit is None or row["conv_id"] != conv:
                    if audit is not None:
                        done.append((conv, "".join(audit), digest.hexdigest()))
                    conv, audit, digest, empty = row["conv_id"], [], hashlib.sha256(), True
                audit.append(row["audit"])
                if row["lines"] is not None:
                    digest.update(row["lines"].encode() if empty else b"\n" + row["lines"].encode())
                    empty = False
            yield written()
        if audit is not None:
            done.append((conv, "".join(audit), digest.hexdigest()))
            yield written()

    return rows.mapInArrow(run, schema)
