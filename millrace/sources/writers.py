"""Writing tables and splits, with a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import named
from millrace.operators.split import SPLIT
from millrace.session import scratch_path

FORMATS = ("jsonl", "parquet", "csv")
SPLITS = ("train", "test", "val")


def safe_name(name: str) -> str:
    return name.replace("/", "_").replace(" ", "_")


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV cells are plain."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, nested)})


def csv_writer(df: DataFrame) -> DataFrameWriter:
    """CSV with a header; cells keep their blanks, which Spark strips unless told not to. Nulls are empty cells, empty texts
    quoted ones."""
    return (
        flat_for_csv(df)
        .write.format("csv")
        .option("header", "true")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("nullValue", "")
        .option("emptyValue", '""')
    )


def write_split(
    df: DataFrame, path: str, fmt: str, compression: str = "snappy", partition_by: str | None = None
) -> str:
    """Write one format below ``path``; null fields keep their key in JSON."""
    if fmt == "jsonl":
        writer = df.write.option("ignoreNullFields", "false").format("json")
    elif fmt == "parquet":
        writer = df.write.option("compression", compression).format("parquet")
    elif fmt == "csv":
        writer = csv_writer(df)
    else:
        raise ValueError(f"unknown format: {fmt}")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.mode("error").save(path)
    return path


def export_split(
    df: DataFrame,
    path: str,
    name: str,
    formats: tuple[str, ...] | list[str] = FORMATS,
    split_col: str = SPLIT,
    compression: str = "snappy",
) -> DataFrame:
    """Write every split in every format; the manifest has a row per format and split.

    Files go to ``{path}/{name}.{fmt}/split={split}``: one write per format, whatever the labels of the splits; a row without one is
    written, but belongs to no split. The first copy is Parquet, below the shared folder if it is not asked for; rows are counted and
    the other formats made from it, so the plan behind ``df`` runs once and nothing depends on cached blocks.
    """
    spark = df.sparkSession
    known = [f for f in sorted(set(formats), key=lambda f: (f != "parquet", list(formats).index(f))) if f in FORMATS]
    base = f"{path.rstrip('/')}/{safe_name(name)}"
    written, rows, source = {}, {}, df
    for fmt in known:
        if source is df:
            first = write_split(df, f"{base}.parquet" if fmt == "parquet" else scratch_path(spark, "export"), "parquet", compression, split_col)
            # with the schema given, labels that look like numbers stay text
            source = spark.read.schema(df.schema).parquet(first).select(*[named(c) for c in df.columns])
            counted = source.filter(named(split_col).isNotNull()).groupBy(named(split_col).alias("split")).count().collect()
            rows = {r["split"]: r["count"] for r in counted}
        written[fmt] = first if fmt == "parquet" else write_split(source, f"{base}.{fmt}", fmt, compression, split_col)
    labels = [s for s in SPLITS if s in rows] + sorted(s for s in rows if s not in SPLITS)
    sizes = _bytes_written(spark, list(written.values()), split_col)
    manifest = [
        (fmt, s, f"{written[fmt]}/{split_col}={s}", rows[s], sizes.get((written[fmt].rsplit("/", 1)[-1], s), 0))
        for fmt in formats
        if fmt in written
        for s in labels
    ]
    return spark.createDataFrame(manifest, "format string, split string, path string, rows bigint, bytes bigint").coalesce(1)


def _bytes_written(spark: SparkSession, folders: list[str], split_col: str) -> dict[tuple[str, str], int]:
    if not folders:
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path", "length")
    parts = F.split("path", "/", -1)
    sizes = files.groupBy(
        F.element_at(parts, -3).alias("folder"),
        F.regexp_replace(F.element_at(parts, -2), f"^{split_col}=", "").alias("split"),
    ).agg(F.sum("length").alias("bytes"))
    return {(r["folder"], r["split"]): r["bytes"] for r in sizes.collect()}


def check_manifest(manifest: DataFrame) -> None:
    """Raise if an expected file set is missing or empty."""
    missing = manifest.filter((F.col("rows") > 0) & (F.col("bytes") == 0)).select("path").collect()
    if missing:
        raise OSError(f"nothing written to {[r['path'] for r in missing]}")
