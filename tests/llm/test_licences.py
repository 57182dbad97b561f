import random
import re

from millrace.llm.licence_scan import BLOCK, PHRASES, SHORT_BLOCK, TEMPLATES, scan_licences


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, templates=TEMPLATES):
    """Every block against every template, and every place of every phrase."""
    w = words_of(text)
    places, base, found = [], set(), set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, words in templates:
        wanted = set(words.lower().split())
        size = SHORT_BLOCK if 2 * len(wanted) <= SHORT_BLOCK else BLOCK
        for at in range(0, max(len(w) - size // 2, 1), size // 2):
            held = len(wanted & set(w[at : at + size]))
            if 100 * held >= 80 * len(wanted):
                found.add((at, label, held / len(wanted)))
    score = 1.0 if base else max([x[2] for x in found], default=0.0)
    return (
        len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {x[1] for x in found})), score, sorted(found),
    )


def texts():
    rng = random.Random(5)
    common = [x for _, t in TEMPLATES for x in t.split()] + ["MIT", "License", "GNU", "the", "of"]
    out = [None, "", "  ", "KELVIN MIT İ License", "mit-license MIT\nLICENSE mit license"]
    for n in range(240):
        parts = []
        for _ in range(rng.choice([1, 2, 5])):
            parts += [rng.choice(["alpha", "beta", "Ärger", "x1", "license"]) for _ in range(rng.choice([0, 10, 150, 700]))]
            template = rng.choice(TEMPLATES)[1].split()
            if n % 3 == 0:
                rng.shuffle(template)
            parts += [x.upper() if rng.random() < 0.3 else x for x in template if rng.random() > rng.choice([0.0, 0.15, 0.3])]
            parts += [rng.choice(common) for _ in range(rng.choice([0, 8, 60]))]
        out.append(rng.choice([" ", "-", "\n", "_"]).join(parts))
    return out


def test_every_row_equals_every_block_against_every_template(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, labels string, score double").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:8] + (sorted(tuple(b) for b in r["blocks"]),) for r in scan_licences(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == plain(t), (i, t)
    assert sum(bool(plain(t)[7]) for _, t in rows) > 100


def test_words_far_apart_are_no_short_licence(spark):
    rng = random.Random(1)
    spread = [f"w{i}" for i in range(300)]
    for k, x in enumerate("spdx license identifier mit".split()):
        spread.insert(70 * k + rng.randrange(10), x)
    df = spark.createDataFrame([(1, " ".join(spread)), (2, "SPDX-License-Identifier: MIT")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in scan_licences(df).collect()} == {1: "", 2: "mit"}


def test_own_templates_and_empty_tables(spark):
    own = [("short", "one two three four five"), ("long", " ".join(f"t{i}" for i in range(60)))]
    rng = random.Random(2)
    some = [" ".join(rng.sample([f"t{i}" for i in range(60)] + ["one", "two", "three", "four", "five"], k)) for k in (3, 20, 49, 55, 60, 64)]
    df = spark.createDataFrame(list(enumerate(some)) * 2 + [(None, "one two three four")], "doc_id long, text string")
    got = [(r["doc_id"], r["labels"], r["score"]) for r in scan_licences(df, templates=own).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(t, own)[5:7]) for i, t in [*enumerate(some)] * 2 + [(None, "one two three four")]], key=str)
    assert scan_licences(df.limit(0)).collect() == []
