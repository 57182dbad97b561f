"""Integrity checks over collections of files: frames with path, length and content, as ``binaryFile`` gives them.

Size and suffix checks never read the content. Only archives need Python, file by file in batches.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fixed_values as fixed
from millrace.functions.encodings import CANDIDATES, log_likelihoods


def suffix(path: Column) -> Column:
    """Last suffix of the file name in lower case, without the dot."""
    name = F.element_at(F.split(path, "/", -1), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def _starts(content: Column, magic: bytes) -> Column:
    return F.coalesce(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit(False))


def parquet_state(content: Column) -> Column:
    """``ok``, ``bad_head`` or ``bad_tail``, from the magic bytes at both ends."""
    tail = F.substring(content, -len(fixed.PARQUET_MAGIC), len(fixed.PARQUET_MAGIC)) == F.lit(fixed.PARQUET_MAGIC)
    return F.when(~_starts(content, fixed.PARQUET_MAGIC), "bad_head").when(tail, "ok").otherwise("bad_tail")


def csv_state(content: Column) -> Column:
    """Whether the first line holds a comma or a tab. Bytes are looked at as Latin-1, which maps each to one char."""
    first = F.substring_index(F.decode(content, "ISO-8859-1"), "\n", 1)
    return F.when(first.contains(",") | first.contains("\t"), "ok").otherwise("no_delimiter")


def unterminated_csv(content: Column) -> Column:
    """Warning: the last byte is no line end."""
    return ~F.hex(F.substring(content, -1, 1)).isin("0A", "0D")


def json_state(content: Column) -> Column:
    return F.when(_starts(content, b"{") | _starts(content, b"["), "ok").otherwise("not_json")


def _zip_state(content: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            unpacked = sum(i.file_size for i in infos)
            # sizes come from the directory, so a bomb is recognised without unpacking it
            if unpacked > fixed.MAX_ZIP_RATIO * len(content):
                return "suspicious_ratio"
            if unpacked > fixed.MAX_UNZIPPED_GB * 1024**3:
                return "too_large_unzipped"
            return "ok" if archive.testzip() is None else "corrupt_member"
    except Exception:  # any failure to read means the archive is unusable
        return "bad_zip"


@F.pandas_udf(T.StringType())
def zip_state(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        yield contents.map(lambda c: None if c is None else _zip_state(bytes(c)), na_action="ignore").astype(object)


def size_gate(files: DataFrame, max_bytes: int = fixed.MAX_FILE_MB * 1024 * 1024) -> DataFrame:
    """Add ``accepted``; content stays unread."""
    return files.withColumn("accepted", F.col("length") <= max_bytes)


def validate_files(files: DataFrame) -> DataFrame:
    """Add ``suffix``, ``state`` and ``is_valid`` (and a line-end warning for CSV). ``expected`` (bytes) is optional.

    Order: empty, truncated (below 95 % of the expected size), too large to have been read, then by suffix. Unknown
    suffixes are valid.
    """
    content = F.col("content")
    staged = files.withColumn("suffix", suffix(F.col("path")))
    zipped = (F.col("suffix") == "zip") | (F.col("suffix").isin("xlsx", "xls") & _starts(content, b"PK"))
    short = F.lit(False)
    if "expected" in files.columns:
        given = F.coalesce(F.col("expected"), F.lit(0))
        short = (given > 0) & (F.col("length") < given * fixed.SIZE_TOLERANCE)
    # only archives travel to Python; all other rows pass a null
    staged = staged.withColumn("_zip", zip_state(F.when(zipped, content)))
    kind = F.col("suffix")
    excel = F.when(_starts(content, b"PK"), F.col("_zip")).when(_starts(content, fixed.OLE_MAGIC), "ok").otherwise("not_excel")
    state = (
        F.when(F.col("length") == 0, "empty")
        .when(short, "truncated")
        .when(content.isNull(), "too_large")
        .when(kind == "csv", csv_state(content))
        .when(kind == "zip", F.col("_zip"))
        .when(kind.isin("parquet", "pq"), parquet_state(content))
        .when(kind.isin("json", "jsonl"), json_state(content))
        .when(kind.isin("xlsx", "xls"), excel)
        .otherwise("not_checked")
    )
    return (
        staged.withColumn("state", state)
        .withColumn("is_valid", F.col("state").isin("ok", "not_checked"))
        .withColumn("warns_line_end", (kind == "csv") & (F.col("length") > 0) & unterminated_csv(content))
        .drop("_zip")
    )


def parquet_magic(files: DataFrame) -> DataFrame:
    return files.withColumn("state", parquet_state(F.col("content")))


def checksum(content: Column, algorithm: str = "md5") -> Column:
    """Hex digest by a built-in function: md5, sha1, sha224, sha256, sha384 or sha512."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(content, int(algorithm[3:]))
    raise ValueError(f"unknown checksum: {algorithm}")


def file_checksums(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    return files.withColumn("checksum", checksum(F.col("content"), algorithm)).drop("content")


def verify_files(files: DataFrame, expected: DataFrame, algorithm: str = "md5") -> DataFrame:
    """Compare with a table (path, expected_hash), ignoring case; files without an entry give null."""
    sums = file_checksums(files, algorithm)
    return sums.join(expected, "path", "left").withColumn(
        "verified", F.lower("checksum") == F.lower("expected_hash")
    )


# --- encodings ---

# Byte-order marks and what they stand for, longest first.
_MARKS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def encoding_sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Log-likelihoods of each content under the encodings that are told apart."""
    for contents in batches:
        yield pd.Series([None if c is None else log_likelihoods(bytes(c)) for c in contents], dtype=object)


def best_encoding(sums: Column) -> Column:
    """The most likely of the encodings by their sums, the first among equals; null where one does not decode."""
    ranked = F.transform(sums, lambda x, i: F.struct((-x).alias("less"), i.alias("at")))
    best = F.array_min(F.filter(ranked, lambda x: x["less"].isNotNull()))
    return F.get(F.array(*[F.lit(n) for n in CANDIDATES]), F.coalesce(best["at"], F.lit(0)))


def detect_encodings(files: DataFrame) -> DataFrame:
    """Add ``encoding``: by byte-order mark, UTF-8 if the whole content is valid, else the most likely encoding that decodes all of it.

    Valid UTF-8 is recognised by a built-in test; only other files without a mark are sent to Python. GBK is told as GB18030, which holds
    it; Latin-1 and Windows-1252 differ in the latter's own signs only, so texts without any are Latin-1. Null content has none.
    """
    content = F.col("content")
    mark = F.lit(None).cast("string")
    for bytes_, name in reversed(_MARKS):
        mark = F.when(_starts(content, bytes_), name).otherwise(mark)
    staged = files.withColumn("_known", F.coalesce(mark, F.when(F.is_valid_utf8(content.cast("string")), "utf-8")))
    staged = staged.withColumn("_sums", encoding_sums(F.when(F.col("_known").isNull(), content)))
    told = F.coalesce("_known", F.when(content.isNotNull(), best_encoding(F.col("_sums"))))
    return staged.withColumn("encoding", told).drop("_known", "_sums")
