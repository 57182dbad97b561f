import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import files as f
from millrace.operators.split import split
from millrace.plans import ordered
from millrace.plans.prepare import prepare
from millrace.session import scratch_path, shared_dir
from millrace.sources import readers as r
from millrace.sources import writers as w


def zipped(text, name="a.txt"):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, text)
    return buffer.getvalue()


OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest"


@pytest.mark.parametrize(
    "name, content, expected, state",
    [
        ("a.csv", b"name,age\nJohn,25\n", None, "ok"), ("a.csv", b"name\nJohn,25\n", None, "no_delimiter"),
        ("a.CSV", b"a\tb", None, "ok"), ("a.csv", b"", None, "empty"), ("a.csv", b"a,b\n", 100, "truncated"),
        ("a.csv", b"a" * 96 + b",", 100, "ok"), ("a.zip", zipped("hello"), None, "ok"), ("a.zip", b"PK\x03\x04junk", None, "bad_zip"),
        ("a.zip", zipped("0" * 2_000_000), None, "suspicious_ratio"), ("a.parquet", b"PAR1xxPAR1", None, "ok"),
        ("a.pq", b"PAR1xx", None, "bad_tail"), ("a.parquet", b"xxxxPAR1", None, "bad_head"), ("a.json", b'{"a":1}', None, "ok"),
        ("a.jsonl", b"[1]", None, "ok"), ("a.json", b" {", None, "not_json"), ("a.xlsx", zipped("x"), None, "ok"),
        ("a.xls", OLE, None, "ok"), ("a.xlsx", b"nothing", None, "not_excel"), ("a.dat", b"x", None, "not_checked"),
        ("noext", b"x", None, "not_checked"),
    ],
)
def test_states(spark, name, content, expected, state):
    rows = [(f"/d.x/{name}", bytearray(content), len(content), expected)]
    df = spark.createDataFrame(rows, "path string, content binary, length long, expected long")
    row = f.validate_files(df).first()
    assert row.state == state and row.is_valid == (state in ("ok", "not_checked"))


def test_damaged_member(spark):
    data = bytearray(zipped("hello world, a longer text to damage " * 5))
    data[45] ^= 0xFF
    df = spark.createDataFrame([("a.zip", data, len(data))], "path string, content binary, length long")
    assert f.validate_files(df).first().state in ("corrupt_member", "bad_zip")


def test_archives_of_any_text_are_sound(spark, tmp_path):
    from millrace.queries import all_queries

    texts = ["", None, "plain text", "Den " * 5000, "é" * 50_000]
    rows = [(i, "web", t) for i, t in enumerate(t for t in texts for _ in range(3))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = all_queries()["validate_zip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, "bad_zip" if i % 3 else "ok") for i in range(15)]


def test_line_end_warning(spark):
    rows = [("a.csv", bytearray(b"a,b\n"), 4), ("b.csv", bytearray(b"a,b"), 3)]
    df = spark.createDataFrame(rows, "path string, content binary, length long")
    assert [x.warns_line_end for x in f.validate_files(df).orderBy("path").collect()] == [False, True]


@pytest.mark.parametrize(
    "content, encoding",
    [
        ("Müller".encode(), "utf-8"), ("José,São Paulo".encode("latin-1"), "latin-1"),
        (b"\xef\xbb\xbfname", "utf-8-sig"), ("Müller".encode("utf-16"), "utf-16"), (b"", "utf-8"), (b"plain", "utf-8"),
    ],
)
def test_encodings(spark, content, encoding):
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    assert f.detect_encodings(df).first().encoding == encoding


def test_encodings_are_told_by_the_whole_file(spark):
    ascii_part = b"plain text " * 20_000
    rows = [(1, ascii_part + "José".encode("latin-1")), (2, ascii_part + "Müller".encode()), (3, ascii_part + "é".encode()[:1])]
    df = spark.createDataFrame(rows, "id int, content binary")
    found = {r.id: r.encoding for r in f.detect_encodings(df).collect()}
    assert found[2] == "utf-8" and not found[1].startswith("utf-8") and not found[3].startswith("utf-8")
    for i, content in rows:
        content.decode(found[i])


def test_checksums(spark):
    df = spark.createDataFrame([("a", bytearray(b"hello"))], "path string, content binary")
    assert f.file_checksums(df).first().checksum == "5d41402abc4b2a76b9719d911017c592"
    expected = spark.createDataFrame([("a", "5D41402ABC4B2A76B9719D911017C592")], "path string, expected_hash string")
    assert f.verify_files(df, expected).first().verified is True
    with pytest.raises(ValueError):
        f.checksum(F.lit(b""), "crc")


def test_csv_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name ,city\nMüller,Köln\n".encode())
    (tmp_path / "b.csv").write_bytes("name,city\nJosé,São Paulo,extra\nshort\n".encode("latin-1"))
    got = r.read_csv(spark, str(tmp_path), schema=None)
    assert got.columns == ["name", "city"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("Müller", "Köln"), ("José", "São Paulo"), ("short", None)], key=str)


def test_csv_reads_what_it_writes(spark, tmp_path):
    rows = [(1, "a\nb"), (2, ""), (3, None), (4, 'q"x", \\ y'), (5, "c\r\nd\re"), (6, " blank "), (7, "\n"), (8, '""')]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    path = w.write_split(df, str(tmp_path / "t"), "csv")
    assert sorted(map(tuple, r.read_csv(spark, path, schema="id int, t string").collect())) == rows
    assert sorted(map(tuple, r.read_csv(spark, path).collect())) == rows
    assert sorted(map(tuple, r.read_dataset(spark, path, "csv").collect())) == rows


def test_csv_headers_and_types_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,score\n1,ann,7\n2,bob,8\n")
    (tmp_path / "b.csv").write_text("score,id,name\r\n9,3,cy\r\n")
    (tmp_path / "c.csv").write_bytes("id,name,score,extra\n4,José,n/a,x\n".encode("latin-1"))
    got = r.read_csv(spark, str(tmp_path))
    want = [(1, "ann", "7", None), (2, "bob", "8", None), (3, "cy", "9", None), (4, "José", "n/a", "x")]
    assert sorted(map(tuple, got.select("id", "name", "score", "extra").collect())) == want
    typed = r.read_csv(spark, str(tmp_path), schema="score double, id int, other string")
    assert typed.columns == ["score", "id", "other"]
    assert sorted(map(tuple, typed.select("id", "score", "other").collect())) == [(1, 7, None), (2, 8, None), (3, 9, None), (4, None, None)]


def test_files_beyond_a_limit_keep_their_rows(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 50)
    assert r.scan_files(spark, str(tmp_path)).first()["content"] == b"x" * 50
    assert r.scan_files(spark, str(tmp_path), max_bytes=10).first()["content"] is None


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "readme.md").write_text("x")
    assert r.data_suffixes(spark, str(tmp_path)) == ["jsonl"]
    assert r.read_dataset(spark, str(tmp_path)).count() == 2


def test_records(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": 2.5, "d": [1]}')], "i int, j string")
    got = r.records_to_table(df, "j").orderBy("i").collect()
    assert float(got[1].a) == 2.5 and got[0].b.c == "x" and got[1].d == [1]


def test_export(spark):
    df = spark.range(120).select("id", F.lit(" padded ").alias("t"), F.array(F.lit(1)).alias("n"))
    labelled = split(df, "random", ["id"], ratios=(0.8, 0.1, 0.1))
    manifest = w.export_split(labelled, scratch_path(spark, "t"), "my/data set", ["jsonl", "parquet", "csv", "xml"])
    rows = {(m.format, m.split): m for m in manifest.collect()}
    assert len(rows) == 9 and all(m.bytes > 0 for m in rows.values())
    assert {s: rows["csv", s].rows for s in ("train", "test", "val")} == {"train": 96, "test": 12, "val": 12}
    assert "/my_data_set.csv/split=train" in rows["csv", "train"].path
    back = r.read_csv(spark, rows["csv", "train"].path, "utf-8", "id long, t string, n string")
    assert back.count() == 96 and back.first().t == " padded " and back.first().n == "[1]"
    w.check_manifest(manifest)
    two = w.export_split(split(df, "random", ["id"]), scratch_path(spark, "t"), "x", ["csv"])
    assert {m.split for m in two.collect()} == {"train", "test"}


def test_prepare(spark):
    rows = [(i, None if i % 9 == 4 else i % 50, "AB"[i % 2], None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, age int, cat string, junk string")
    done = prepare(df, scratch_path(spark, "p"), "demo", ["id"], ["id"], formats=("parquet",))
    assert done.strategy == "stratified" and done.recipe.drop_columns == ["junk"]
    s = done.summary.first()
    assert (s.original_rows, s.cleaned_rows, s.train_rows, s.test_rows, s.val_rows) == (200, 200, 160, 40, 0)
    capped = prepare(df, scratch_path(spark, "p"), "demo", ["id"], ["id"], max_rows=50, formats=("jsonl",))
    assert capped.summary.first().original_rows == 50


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")


def test_files_too_large_to_read_are_still_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,b\n" + "1,2\n" * 50)
    found = r.scan_files(spark, str(tmp_path), max_bytes=100)
    states = {x.path.rsplit("/", 1)[-1]: x.state for x in f.validate_files(found).collect()}
    assert states == {"a.csv": "ok", "b.csv": "too_large"}


def test_many_head_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_ROWS", 10)
    df = spark.range(1000).withColumn("t", F.col("id") % 7)
    want = df.orderBy("t", "id").limit(333)
    got = r.head_rows(df, 333, ["t", "id"])
    assert sorted(got.collect()) == sorted(want.collect())
    assert r.head_rows(df, 5000, ["t", "id"]).count() == 1000


@pytest.mark.parametrize("formats", [["csv"], ["jsonl", "csv"], ["csv", "parquet"]])
def test_manifest_of_any_label(spark, formats):
    labels = ["train", "dev", "01", "train", "dev", "dev", None]
    df = spark.createDataFrame([(i, "line\nfeed", s) for i, s in enumerate(labels)], "id long, text string, split string")
    manifest = w.export_split(df, scratch_path(spark, "t"), "x", formats)
    rows = [(m["format"], m["split"], m["rows"]) for m in manifest.collect()]
    assert rows == [(fmt, s, n) for fmt in formats for s, n in (("train", 2), ("01", 1), ("dev", 3))]
    w.check_manifest(manifest)
    assert all(m["bytes"] > 0 for m in manifest.collect())
