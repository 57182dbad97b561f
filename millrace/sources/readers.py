"""Reading tables: CSV in any encoding, Parquet, JSON lines, JSON documents, folders of them, and JSON columns."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fixed_values as fixed
from millrace.functions.cells import named
from millrace.operators.clean import clean_header, clean_headers
from millrace.operators.files import best_encoding, encoding_sums, suffix
from millrace.plans.ordered import first_rows

# Java names of encodings that Spark spells differently.
_JAVA_NAMES = {
    "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-16": "UTF-16",
    "cp1252": "windows-1252",
}

_BUILT_IN = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32")

# The longest array of bytes that Java holds.
MAX_CONTENT = 2**31 - 1024
# Stands for unquoted empty cells while a file is parsed, so that quoted ones stay empty text.
NULL_CELL = "\x00"


def scan_files(
    spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_CONTENT
) -> DataFrame:
    """Files as rows: path, modificationTime, length, content. Content is only read by plans that use it.

    A file is one row, and a binary value holds 2 GB at most: the content of files above ``max_bytes`` is left null, the rows are
    there all the same.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    large = files.filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return files.filter(F.col("length") <= max_bytes).unionAll(large)


def _lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``path, value, at``: lines of text files as raw bytes, ``at`` rising within a file; large files are read by many tasks."""
    return _reader(spark, glob=glob).option("recursiveFileLookup", "true").text(paths).select(
        F.col("_metadata.file_path").alias("path"), "value",
        # a task reads a file's block from its start on, so that these two put the lines of a file in order
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )


def text_layouts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, encoding, header) of text files of any size: UTF-16 by its mark, UTF-8 if every line is valid, else the encoding
    that makes all lines together most likely; the header is the file's first line.

    Nothing is held whole. Only files that are not valid UTF-8 are read again, their lines scored where they lie and the sums
    added up per file. A line feed is no part of any other character in these encodings, so lines can be scored one by one.
    """
    marked = F.substring(F.col("value").cast("binary"), 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))
    seen = _lines(spark, path, glob).groupBy("path").agg(
        F.bool_or(marked).alias("marked"), F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.min_by("value", "at").alias("header"),
    )
    told = F.when(F.col("marked"), "utf-16").when(F.col("valid"), "utf-8")
    layouts = seen.select("path", told.alias("encoding"), F.rtrim("header", F.lit("\r")).alias("header"))
    other = [r["path"] for r in layouts.filter("encoding is null").select("path").collect()]  # names, as any listing of the folder
    if not other:
        return layouts
    # Lines of ASCII alone are as likely in any of the encodings, but for a factor that is the same for all files.
    lines = _lines(spark, [unquote(p) for p in other]).filter(F.col("value").rlike(r"[^\x{0}-\x{7f}]"))
    sums = lines.select("path", F.posexplode(encoding_sums(F.col("value").cast("binary"))).alias("at", "sum"))
    per_file = sums.groupBy("path", "at").agg(F.when(F.bool_and(F.col("sum").isNotNull()), F.sum("sum")).alias("sum"))
    scored = per_file.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "sum"))).alias("_sums"))
    best = scored.select("path", best_encoding(F.transform("_sums", lambda x: x["sum"])).alias("_best"))
    return layouts.join(best, "path", "left").select("path", F.coalesce("encoding", "_best").alias("encoding"), "header")


def _reader(spark: SparkSession, schema: str | T.StructType | None = None, glob: str | None = None) -> DataFrameReader:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("pathGlobFilter", glob) if glob else reader


def _csv(
    spark: SparkSession, paths, schema, encoding: str, glob: str | None = None, rejects: str | None = None,
    single_line: bool = False, infer: bool = False,
) -> DataFrame:
    if schema is not None and rejects:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*fields.fields, T.StructField(rejects, T.StringType())])
    java_name = _JAVA_NAMES.get(encoding, encoding)
    if java_name.upper() not in _BUILT_IN:
        # Spark reads its own few encodings only, unless this session setting lets it ask Java for others.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # UTF-16 can not be cut at line feeds, whatever its cells hold
    whole = not single_line or encoding.lower().startswith("utf-16")
    reader = (
        _reader(spark, schema, glob)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("encoding", java_name)
        .option("escape", '"')
        .option("multiLine", str(whole).lower())
        .option("nullValue", NULL_CELL)
        .option("emptyValue", "")
        .option("inferSchema", str(infer).lower())
    )
    if rejects:
        reader = reader.option("columnNameOfCorruptRecord", rejects)
    return reader.csv(paths)


def _wider(one: T.DataType, other: T.DataType) -> T.DataType:
    """A type that holds the values of two inferred ones."""
    numbers = [T.IntegerType(), T.LongType(), T.DoubleType()]
    times = [T.DateType(), T.TimestampNTZType(), T.TimestampType()]
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    for ranks in (numbers, times):
        if one in ranks and other in ranks:
            return ranks[max(ranks.index(one), ranks.index(other))]
    return T.StringType()


def _by_name(fields: list[T.StructField]) -> dict[str, T.DataType]:
    return {clean_header(f.name): f.dataType for f in fields}


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "auto",
    schema: str | T.StructType | None = None,
    glob: str | None = None,
    single_line: bool = False,
    uniform: bool = False,
) -> DataFrame:
    """CSV with a header; cells that do not fit the schema are null, surplus cells are dropped, headers are cleaned.

    An unquoted empty cell is null, a quoted one empty text. Cells may hold line feeds, so a file is one task; ``single_line=True``
    cuts large files into many, for files known to hold a record per line.

    Files are grouped by encoding (with ``"auto"``, see ``text_layouts``) and header in a pass of its own; encodings that Spark does not
    read by itself switch on ``spark.sql.legacy.javaCharsets`` in the session. Each group is read with its own header, and
    columns are matched by name: those of ``schema``, null where a file has none, or without a schema all there are, each in a
    type that fits all files. ``uniform=True`` skips the pass for files that share an encoding and a header; a schema then names
    columns by position.
    """
    fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields if schema else None
    if uniform:
        encoding = "utf-8" if encoding == "auto" else encoding
        return clean_headers(_csv(spark, path, schema, encoding, glob, single_line=single_line, infer=schema is None))
    layouts = text_layouts(spark, path, glob)
    if encoding != "auto":
        layouts = layouts.withColumn("encoding", F.lit(encoding))
    kinds = sorted(layouts.select("encoding", "header").distinct().collect())  # few, unlike files
    if not kinds:
        return clean_headers(_csv(spark, path, schema, "utf-8", glob, single_line=single_line, infer=schema is None))
    groups = [(kinds[0]["encoding"], path, glob)]
    if len(kinds) > 1:
        files: dict[tuple, list[str]] = {}
        for r in layouts.collect():  # file names, as any listing of the folder
            files.setdefault((r["encoding"], r["header"]), []).append(r["path"])
        groups = [(e, sorted(paths), None) for (e, _), paths in sorted(files.items())]
    if fields is None:
        inferred = [_csv(spark, p, None, e, g, single_line=single_line, infer=True) for e, p, g in groups]
        if len(groups) == 1:
            return clean_headers(inferred[0])
        types: dict[str, T.DataType] = {}
        for part in inferred:
            for name, dtype in _by_name(clean_headers(part).schema.fields).items():
                types[name] = _wider(types.get(name, dtype), dtype)
    else:
        types = _by_name(fields)
    parts = []
    for e, p, g in groups:
        header = clean_headers(_csv(spark, p, None, e, g, single_line=single_line)).columns
        own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        part = _csv(spark, p, own, e, g, single_line=single_line)
        missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in header}
        parts.append((part.withColumns(missing) if missing else part).select(*[named(c) for c in types]))
    return reduce(DataFrame.unionAll, parts)


def read_csv_lenient(
    spark: SparkSession, path: str, schema: str | T.StructType, rejects: str = "_rejected", single_line: bool = False
) -> DataFrame:
    """Plain CSV of one header: bad cells become null, and the raw record of a row with any is kept in ``rejects``."""
    return _csv(spark, path, schema, "utf-8", rejects=rejects, single_line=single_line)


def read_parquet(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return _reader(spark, glob=glob).parquet(path)


def read_jsonl(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, glob: str | None = None
) -> DataFrame:
    return _reader(spark, schema, glob).json(path)


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, glob: str | None = None
) -> DataFrame:
    """JSON documents, each an array of records or one record."""
    return _reader(spark, schema, glob).option("multiLine", "true").json(path)


def data_suffixes(spark: SparkSession, path: str) -> list[str]:
    """Known data suffixes below a path, in the order they are preferred."""
    found = scan_files(spark, path).select(suffix(F.col("path")).alias("s")).distinct().collect()
    present = {r["s"] for r in found}
    return [s for s in fixed.DATA_SUFFIXES if s in present]


def read_dataset(
    spark: SparkSession, path: str, fmt: str = "auto", schema: str | T.StructType | None = None
) -> DataFrame:
    """Read all files below a path that have the chosen format's suffix, by default the first known suffix present."""
    if fmt == "auto":
        known = data_suffixes(spark, path)
        if not known:
            raise ValueError(f"no data files below {path}")
        fmt = known[0]
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in fmt)
    if fmt == "parquet":
        return read_parquet(spark, path, glob)
    if fmt == "csv":
        return read_csv(spark, path, "auto", schema, glob)
    if fmt == "jsonl":
        return read_jsonl(spark, path, schema, glob)
    if fmt == "json":
        return read_json(spark, path, schema, glob)
    raise ValueError(f"unsupported format: {fmt}")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Even out rows of a table stored in fewer files than there are cores, before CPU-heavy row-wise work.

    Each row group is one task, so a single big file would keep one core busy. Tables of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if len(df.inputFiles()) < cores else df


def head_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows in order (returned as a set; ``order_by`` must be unique)."""
    return first_rows(df, order_by, n)


def infer_json_schema(df: DataFrame, column: str) -> str:
    """Schema over all values of a JSON column: partial schemas are merged by the aggregation, none is sampled."""
    merged = df.select(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    return merged.replace("OBJECT<", "STRUCT<") if merged else "STRUCT<>"


def records_to_table(df: DataFrame, json_col: str, schema: str | None = None) -> DataFrame:
    """A column of JSON objects to columns; nested values keep their structure."""
    schema = schema or infer_json_schema(df, json_col)
    parsed = df.withColumn("_record", F.from_json(json_col, schema))
    return parsed.select(*[c for c in df.columns if c != json_col], "_record.*")
