import random

import pytest

from millrace.functions.encodings import CANDIDATES, log_likelihoods, most_likely
from millrace.operators import files as f
from millrace.sources import readers as r

TEXTS = {
    "latin-1": "Les élèves étaient très fatigués à la fin de l'été, où ça où là. Ñandú über schöne Straßen. ",
    "windows-1252": "“C’est très cher”, dit-il – 20 € l’unité… ",
    "gb18030": "这是一个测试文件，里面有很多中文字符。我们希望能够正确地识别编码。",
    "shift_jis": "これはテストファイルです。日本語の文字コードを正しく判定できるでしょうか。",
    "euc-jp": "これはテストファイルです。日本語の文字コードを正しく判定できるでしょうか。",
    "euc-kr": "이것은 시험 파일입니다. 우리는 한국어 문자 인코딩을 올바르게 판별하고 싶습니다.",
    "utf-16le": "Plain words, and some élèves. 这是 ",
    "utf-16be": "Plain words, and some élèves. 这是 ",
}


@pytest.mark.parametrize("name", CANDIDATES)
@pytest.mark.parametrize("times", [1, 40])
def test_encodings_are_told_apart(name, times):
    assert most_likely(log_likelihoods((TEXTS[name] * times).encode(name))) == name


def test_pieces_of_texts_are_told_apart():
    rng = random.Random(3)
    right = total = 0
    for name, text in TEXTS.items():
        for _ in range(50):
            at = rng.randrange(max(len(text) - 30, 1))
            content = text[at : at + 30].encode(name)
            if not content.isascii() or name.startswith("utf-16"):
                total += 1
                found = most_likely(log_likelihoods(content))
                # without a sign of the code page's own, its texts are Latin-1 as well
                right += found == name or (name == "windows-1252" and content.decode("latin-1") == text[at : at + 30])
    assert right >= 0.95 * total


def test_short_texts_of_frequent_characters_are_told_apart():
    frequent = {"gb18030": "的一是不了在人有我他", "euc-jp": "のにはを日本人年大中", "shift_jis": "のにはを日本人年大中", "euc-kr": "이다는을가에의고하지"}
    for name, letters in frequent.items():
        for text in [*letters, *(a + b + "." for a in letters for b in letters), *(c * 5000 for c in letters)]:
            assert most_likely(log_likelihoods(text.encode(name))) == name, (name, text[:2])


def test_sums_over_chunks_are_sums_over_the_whole(monkeypatch):
    from millrace.functions import encodings

    content = (TEXTS["euc-jp"] * 300).encode("euc-jp")
    whole = log_likelihoods(content)
    monkeypatch.setattr(encodings, "CHUNK", 7)
    assert [x is None for x in log_likelihoods(content)] == [x is None for x in whole]
    assert all(a is None or abs(a - b) < 1e-6 * abs(b) for a, b in zip(log_likelihoods(content), whole, strict=True))
    assert most_likely([None] * len(CANDIDATES)) == "latin-1" and log_likelihoods(b"") == [0.0] * len(CANDIDATES)


def test_files(spark):
    contents = {n: (t * 3).encode(n) for n, t in TEXTS.items()}
    contents |= {
        "utf-8": TEXTS["gb18030"].encode(), "utf-8-sig": TEXTS["latin-1"].encode("utf-8-sig"), "utf-16": TEXTS["euc-kr"].encode("utf-16"),
        "late": b"plain " * 100_000 + "déjà vu".encode("latin-1"), "empty": b"", "null": None,
    }
    df = spark.createDataFrame([(n, c, "x") for n, c in contents.items()], "path string, content binary, encoding_ string")
    found = {row["path"]: row["encoding"] for row in f.detect_encodings(df).collect()}
    assert found == {n: n for n in contents} | {"late": "latin-1", "empty": "utf-8", "null": None}


@pytest.mark.parametrize("name", ["latin-1", "windows-1252", "gb18030", "shift_jis", "euc-jp", "euc-kr"])
def test_csv_in_any_encoding(spark, tmp_path, name):
    words = TEXTS[name].replace(",", " ").replace("\n", " ")
    lines = [f"{i},{words[i % 20 :]}" for i in range(200)]
    (tmp_path / "a.csv").write_bytes(("id,text\n" + "\n".join(lines) + "\n").encode(name))
    (tmp_path / "b.csv").write_bytes(("id,text\n" + "\n".join(f"{200 + i},plain é {i}" for i in range(9)) + "\n").encode())
    back = {row["id"]: row["text"] for row in r.read_csv(spark, str(tmp_path), schema="id int, text string").collect()}
    assert len(back) == 209 and back[200] == "plain é 0"
    assert all(back[i] == words[i % 20 :] for i in range(200))
