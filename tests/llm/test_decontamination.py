import random

import numpy as np
import pytest

from millrace.llm.decontamination import benchmark_leaks, drop_leaks, tokens


def share(item, text):
    """The textbook recurrence over the whole text."""
    a, b = tokens(item), tokens(text)
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best = max(best, max(row))
        above = row
    return best / (2 * len(a))


def edited(words, every, how, rng):
    out = []
    for i, w in enumerate(words):
        if i % every != every - 1:
            out.append(w)
        elif how == "replace":
            out.append(f"r{rng.randrange(10**6)}")
        elif how == "insert":
            out += [w, f"r{rng.randrange(10**6)}"]
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    common = "which of the following is a not".split()
    return [(i, [rng.choice(common) if rng.random() < 0.3 else f"v{rng.randrange(4000)}" for _ in range(n)]) for i, n in enumerate([30, 42, 60, 90])]


def test_edited_copies_are_those_of_the_whole_alignment(spark, items):
    """Every pair of a text and an item that the whole alignment puts at one half or more, over edits of every 2nd to 6th word."""
    rng = random.Random(4)
    filler = [f"v{i}" for i in range(4000)] + "which of the following is a not".split() * 200
    texts = []
    for _, words in items:
        for how in ("replace", "insert", "delete"):
            for every in range(2, 7):
                around = [rng.choice(filler) for _ in range(80)]
                texts.append(" ".join(around[:40] + edited(words, every, how, rng) + around[40:]))
        texts.append(" ".join(words[: len(words) * 3 // 5]))
        texts.append(" ".join(rng.choice(filler) for _ in range(200)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(d, i): s for d, t in enumerate(texts) for i, w in items if (s := share(" ".join(w), t)) >= 0.5}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in benchmark_leaks(docs, tests).collect()}
    assert got == pytest.approx(want) and len(want) >= 50
    kept = {r["doc_id"] for r in drop_leaks(docs, tests).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_random_edits(spark, items):
    """Recall over mixed random edits; what has no seed left is all that may be missed."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        words = []
        for w in items[rng.integers(len(items))][1]:
            x = rng.random()
            words += [w] if x > 0.4 else [f"n{rng.integers(10**6)}"] if x > 0.2 else [] if x > 0.1 else [w, f"n{rng.integers(10**6)}"]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, w in items if share(" ".join(w), t) >= 0.5}
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(docs, tests).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and want


def test_tables_of_any_shape(spark):
    item = "one two three four five six seven eight"
    rows = [(1, item, 0.1, "a"), (1, item, 0.1, "a"), (None, item, 0.2, "b"), (2, None, 0.0, "c"), (3, "", 0.0, "d"), (4, "w " * 50000 + item, 0.0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, item_id string")
    tests = spark.createDataFrame([(7, item, "x"), (None, item, "x"), (8, None, "x"), (9, "two words", "x")], "item_id long, text string, doc_id string")
    found = benchmark_leaks(docs, tests)
    assert found.columns == ["doc_id", "item_id", "score", "first_word", "end_word", "passages"]
    got = sorted((r["doc_id"] or 0, r["item_id"], r["score"], r["first_word"]) for r in found.collect())
    assert got == [(0, 7, 1.0, 0), (1, 7, 1.0, 0), (1, 7, 1.0, 0), (4, 7, 1.0, 50000)]
    assert sorted(r["doc_id"] for r in drop_leaks(docs, tests).collect()) == [2, 3] and drop_leaks(docs, tests).columns == docs.columns
    assert benchmark_leaks(docs.limit(0), tests).collect() == benchmark_leaks(docs, tests.limit(0)).collect() == []
