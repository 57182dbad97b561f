import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm.boosting import fit_boosted, threshold
from millrace.llm.personal_data import KINDS, base_spans, find_personal_data, redact_personal_data
from millrace.llm.spans import in_order, masked, matches, running_sums


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def rules(text):
    """The fixed patterns by Python's own matcher."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def tuples(spans):
    return [tuple(s) for s in spans]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "_d@e.f.g", "@", ".", "-", "+", "1", "42", "300.1.2.3", "1.2.3.4", "001.02.3.255", "+1 (988) 555-2485", " ", "é",
            "😀", "x", "4041894974608795", "4041 8949-7460 8795", "%", "+49 30 123456", "(", ")", "\n", "256", "0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["1" * 30000, "a" * 30000, "a." * 20000 + "@", "+1" + " " * 30000, "1 " * 20000, "1." * 20000, "a@b.c " * 1000 + "1.2.3.4", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8)
    got = {r["i"]: tuples(r["s"]) for r in df.select("i", in_order(base_spans(F.col("t"))).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == rules(text), text[:200]


def test_matches_and_sums(spark):
    numbers = [[], [3], list(range(1, 400)), [0] * 1000]
    df = spark.createDataFrame([(n,) for n in numbers], "n array<int>")
    got = [r[0] for r in df.select(running_sums(F.col("n"))).collect()]
    assert got == [[sum(n[:i]) for i in range(len(n))] for n in numbers]
    df = spark.createDataFrame([("é12 x345y 6",), ("",), ("none",)], "t string")
    got = [tuples(r[0]) for r in df.select(matches(F.col("t"), "[0-9]+", F.lit(True), context=2)).collect()]
    assert got == [[(1, 3, "12", "é", " x"), (5, 8, "345", " x", "y "), (10, 11, "6", "y ", "")], [], []]


def test_masks(spark):
    df = spark.createDataFrame([("0123456789", [(0, 2, 4), (1, 3, 6), (0, 6, 7), (0, 9, 10)]), ("é", []), (None, [])],
                               "t string, s array<struct<kind:int,start:int,end:int>>")
    assert [r[0] for r in df.select(masked(F.col("t"), F.col("s"), "#")).collect()] == ["01##78#", "é", None]


@pytest.fixture(scope="module")
def mail(spark):
    """Texts with personal data of all kinds, numbers that are none, and a few that fail only a rule."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(600):
        rows.append((i, f"{word()} call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} {word()}, {'card ' if i % 2 else ''}{card(rng)} {word()} "
                        f"mail {word()}@{word()}.example.com or {'.'.join(str(rng.randint(1, 255)) for _ in range(4))} {word()}"))  # fmt: skip
        rows.append((1000 + i, f"{word()} order {rng.randint(10**11, 10**12 - 1)} of {rng.randint(1000, 2020)}, batch x{rng.randint(10**15, 10**16)}x"))
    rows += [
        (2000, f"call +1 (555) 555-1234 {card(rng)} {word()}"), (2001, "call (555) 555-1234 today"), (2002, f"{word()} card 4111111111111112 {word()}"),
        (2003, f"mail {word()} (at) {word()} (dot) com now"), (2004, "order 123456789012 of 1999, batch x1234567890123456x"),
        (2005, None), (2006, ""), (None, "call +1 (555) 555-1234 now"), (2000, "nothing at all"),
    ]
    return spark.createDataFrame([(*r, 5, [1.0]) for r in rows], "doc_id long, text string, kind int, found array<double>")


def test_proposals_are_judged_by_the_company_they_keep(mail):
    found = find_personal_data(mail).collect()
    assert len(found) == mail.count()
    texts = {}
    for r in mail.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in found:
        assert tuples(r["base"]) in [rules(t or "") for t in texts[r["doc_id"]]]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in r["base"]) for i in range(4)]
        assert set(tuples(r["base"])) <= set(tuples(r["found"])) and tuples(r["found"]) == sorted(set(tuples(r["found"])))
    added = {r["doc_id"]: set(tuples(r["found"])) - set(tuples(r["base"])) for r in found if r["doc_id"] != 2000}
    glued = [r for r in found if r["doc_id"] == 2000 and r["found"]]
    assert len(glued) == 1 and not glued[0]["base"] and tuples(glued[0]["found"]) == [(2, 23, 39), (3, 5, 22)]
    assert added[2001] == {(3, 5, 19)} and len(added[2002]) == 1 and len(added[2003]) == 1
    assert not any(added[i] for i in range(1000, 1600)) and not added[2004] and not added[2005] and not added[2006]
    assert not any(added[i] for i in range(600))


def test_redaction(mail):
    out = redact_personal_data(mail, mask="#")
    assert out.columns == mail.columns and out.count() == mail.count()
    texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id >= 2001 or doc_id is null").collect()}
    assert texts[None] == "call # now" and texts[2001] == "call # today" and texts[2005] is None and texts[2006] == ""


def test_few_or_no_rows(spark, mail):
    assert find_personal_data(mail.limit(0)).count() == 0 and redact_personal_data(mail.limit(0)).count() == 0
    one = find_personal_data(spark.createDataFrame([(1, "only a@b.c and (555) 555-1234")], "doc_id long, text string")).first()
    assert tuples(one["found"]) == tuples(one["base"]) == [(0, 5, 10)]


def test_boosting_learns_an_interaction(spark):
    rows = [(a, b, 90 if (a > 1) != (b == 2) else 10, 100) for a in range(4) for b in range(4)]
    histogram = spark.createDataFrame(rows, "a int, b int, pos long, n long")
    model = fit_boosted(histogram, {"a": True, "b": False}, rounds=12)
    p = model.probability(F.col)
    for r in histogram.withColumn("p", p).collect():
        assert (r["p"] > 0.7) == (r["pos"] == 90) and (r["p"] < 0.3) == (r["pos"] == 10)
    assert fit_boosted(histogram.filter("false"), {"a": True}).trees == ()


def test_thresholds():
    assert threshold([(0.9, 100, 100), (0.5, 90, 100), (0.1, 0, 100)], 0.9) == 0.5
    assert threshold([(0.9, 1000, 1000), (0.5, 5, 10), (0.4, 7, 10)], 0.9) == 0.9
    assert threshold([(0.9, 95, 100), (0.8, 100, 100), (0.2, 1, 1), (0.1, 1, 100)], 0.9) == 0.2
    assert threshold([(0.9, 5, 5)], 0.9) > 1 and threshold([], 0.9) > 1
