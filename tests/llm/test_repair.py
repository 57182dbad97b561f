import hashlib
import itertools
import random
import re
import zlib

import pytest

from millrace.llm import repair
from millrace.llm.repair import BlockTables, Costs, conversation_report, damage_conversations, repair_conversations, repaired_rows

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, audit, lines) over every way through the rows, by dynamic programming over the plain definition."""
    roles = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}  # by what the roles' initials come to: nothing, s, or the last of u and a

    def follow(state, c):
        return {"s": "s" if state == "" else None, "u": None if state == "u" else "u", "a": "a" if state == "u" else None}.get(c)

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for c in "ua":
                    to = follow(state, c)
                    new = (cost + 3, audit + "I", (*lines, roles[c] + ":"))
                    if to is not None and new < best.get(to, (10**9,)):
                        best[to] = new
        return best

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}

        def take(state, option, new=new):
            if option < new.get(state, (10**9,)):
                new[state] = option

        for state, (cost, audit, lines) in inserted(best).items():
            take(state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if role and follow(state, role[0]) is not None:
                take(follow(state, role[0]), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for c in "ua":
                if follow(state, c) is not None:
                    take(follow(state, c), (cost + 3 + extra, audit + "R", (*lines, f"{roles[c]}:{text}")))
        best = new
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def every_edit(rows):
    """All sequences of edits of a short conversation: the least cost, and the first audit in order of those that cost that."""
    found = []
    marks = faults(rows)
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for ops in itertools.product("DKR", repeat=len(rows)):
            slots, cost = [], 3 * sum(inserts)
            audit = ""
            for i, (op, (role, _)) in enumerate(zip(ops, rows, strict=True)):
                audit += "I" * inserts[i] + op
                slots += ["*"] * inserts[i] + ([] if op == "D" else [role[:1] if op == "K" else "*"])
                cost += {"D": 4, "K": 0, "R": 3}[op] + (3 if op != "D" and marks[i] == "truncated" else 0)
                if op != "D" and marks[i] in ("blank", "duplicate"):
                    cost = 10**9
            audit += "I" * inserts[-1]
            slots += ["*"] * inserts[-1]
            shapes = ["ua" * k for k in range(4)] + ["s" + "ua" * k for k in range(1, 4)]
            if any(len(s) == len(slots) and all(a == b or a == "*" and b != "s" for a, b in zip(slots, s, strict=True)) for s in shapes):
                found.append((cost, audit))
    return min(found)


def brute_force(rows):
    """The report of one conversation whose damaged rows (turn, role, text) are in order."""
    pairs = [r[1:] for r in rows]
    marks, turns = faults(pairs), [r[0] for r in rows if r[0] is not None]
    cost, audit, lines = cheapest(pairs)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"),
        marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = repair_conversations(df).persist()
    got = {r[0]: tuple(r)[1:] for r in conversation_report(found, df).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if role is None else role, " " if x is None else x) for c, t, role, x in rows if c == conv]
        want[conv] = brute_force(ordered(mine))
    assert got == want
    lines = {}
    for r in repaired_rows(found).orderBy("conv_id", "place", "part").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, kept in lines.items():
        assert SHAPE.fullmatch("".join(r[0] for r, _ in kept))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest() == got[conv][-1]
    return got


def made(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "umpire", None])
            text = rng.choice([f"Hello {turn}.", "Same.", "cut off", f"cut {turn}", " \n", "", None, "Why? \t", "é!"])
            rows.append((conv, rng.choice([turn, turn, turn, None, -turn]), role, text))
    return rows


def test_the_tables_agree_with_every_edit_of_short_conversations():
    tables = BlockTables(Costs(), 2)
    options = [("system", "s."), ("user", "u."), ("assistant", "a."), ("tool", "t."), ("user", "cut"), ("assistant", "cut"), ("user", "")]
    for n in range(4):
        for rows in itertools.product(options, repeat=n):
            marks = faults(rows)
            symbols = "".join(
                "8" if m in ("blank", "duplicate") else str(2 * "sua".find(r[0]) % 8 + (m == "truncated")) for (r, _), m in zip(rows, marks, strict=True)
            ).replace("-", "")
            left, steps = tables.trace(symbols, 0, 0)
            audit = re.sub("[UA]", "R", re.sub("[ua]", "I", "".join(steps))) + {1: "II", 2: "I"}.get(left, "")
            cost, want = every_edit(rows) if n else (0, "")
            assert audit == want, (rows, audit, want, cost)
            assert cheapest(rows)[:2] == (cost, want)


@pytest.mark.parametrize("piece_rows", [4, 1 << 16])
def test_random_conversations(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    rows = made(random.Random(piece_rows), 40, 14)
    report(spark, rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "cut"), (99, None, "system", "only.")])


def test_one_conversation_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 8)
    rng = random.Random(11)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "x."])) for t in range(600)]
    report(spark, rows + [(7, 5, "user", "Again.")] * 50 + [(8, 0, "user", "Hi.")])


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {c}. {t}? Yes!") for c in range(30) for t in range(4)]
    rows += [(None, 3, None, None), (5, None, "user", None)]
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            row = (c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            want += [row] * (2 if h == 3 else 1)
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], SCHEMA + ", place double, fault string")
    damaged = damage_conversations(df)
    assert sorted(map(str, map(tuple, damaged.collect()))) == sorted(map(str, want))
    got = {r[0]: tuple(r)[1:] for r in conversation_report(repair_conversations(damaged), df).collect()}
    assert set(got) == {r[0] for r in rows}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv, found in got.items():
        mine = ordered([r[1:] for r in want if r[0] == conv])
        assert found == (brute_force(mine) if mine else empty)


def test_no_rows_and_long_texts(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(df).count() == 0 and conversation_report(repair_conversations(df), df).count() == 0
    long = "word " * 100_000
    report(spark, [(1, 0, "user", long + "?"), (1, 1, "assistant", long), (1, 2, "assistant", long + "!"), (1, 3, "user", long + "?")])
