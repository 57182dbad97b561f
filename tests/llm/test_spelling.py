import random
import re
import zlib
from collections import Counter

from millrace.llm.spelling import neighbours, rotations, spelling_variants, word_counts


def near(a: str, b: str) -> bool:
    """One insertion, deletion or replacement apart, by trying every one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_force(counts: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    forms, numbers = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        numbers[w] = len(close)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (n, forms[w], root, numbers[w], counts[forms[w]] if forms[w] else None)
    return out


def found(df):
    rows = [(r["word"], (r["n"], r["form"], r["root"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_few_letters_many_repeats(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(400):
        counts["".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))] = rng.choice([1, 2, 3, 20, 30, 400, 5000])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling_variants(words)) == brute_force(counts)


def test_chains_and_ties(spark):
    counts = {"abcdefg": 10**6, "abcdefgh": 10**5, "abcdefghi": 10**4, "abcdefghij": 1000, "abcdefghijk": 100, "abcdefghijkl": 10,
              "abcdefghijklm": 1, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "zzzzzzé": 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling_variants(words))
    assert got == brute_force(counts)
    assert got["abcdefghijklm"][2] == "abcdefg" and got["zzzzzzz"][1] == "zzzzzzx"


def test_a_group_is_no_larger_than_the_alphabet(spark):
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"
    counts = {"frequen" + c + "y": i + 1 for i, c in enumerate(letters)} | {"frequeny": 1000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rotations(words).groupBy("prefix").count().agg({"count": "max"}).first()[0] == len(counts)
    got = found(spelling_variants(words))
    assert got == brute_force(counts)
    assert {r["n_near"] for r in neighbours(words).collect()} >= {len(counts) - 1}


def test_words_of_texts(spark):
    long = "verylongword " * 20000
    texts = [
        (1, "Spelling spelling SPELLING Àspell×ing 7spelling_x"), (2, None), (3, ""), (None, "spelling short"), (4, long),
        (4, long), (5, "ﬁspelling Ωmegawords çççççççç Ççççççç"),
    ]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, word string, n int")
    want, planted = Counter(), Counter()
    for i, t in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub(r"[A-Z]", lambda m: m.group().lower(), run)
            want[run] += 1
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            planted[run[:at] + run[at + 1 :] if h % 3 == 0 else run] += 1
    for every, counts in ((0, want), (3, planted)):
        got = {r["word"]: r["n"] for r in word_counts(docs, least_length=7, least_count=1, typo_every=every).collect()}
        assert got == {w: n for w, n in counts.items() if len(w) >= 7}
    assert found(spelling_variants(word_counts(docs, typo_every=3))) == brute_force(
        {w: n for w, n in planted.items() if len(w) >= 7 and n >= 2}
    )
    assert word_counts(docs.limit(0)).count() == 0 and spelling_variants(word_counts(docs.limit(0))).count() == 0


def test_odd_words(spark):
    words = spark.createDataFrame([(None, 3, "a"), ("", 2, "b"), ("a$b", 9, "c"), ("ab", 30, "d"), ("abc", 1, "e")], "word string, n long, form string")
    got = found(spelling_variants(words))
    assert got == {None: (3, None, None, 0, None), "": (2, None, "", 0, None), "a$b": (9, None, "a$b", 0, None),
                   "ab": (30, None, "ab", 1, None), "abc": (1, "ab", "ab", 1, 30)}
