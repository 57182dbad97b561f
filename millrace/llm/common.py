"""What the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import scratch_path

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def staged(df: DataFrame, name: str, work: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder (or ``work``) and read it back: later jobs start from files, not from lineage.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{work.rstrip('/')}/{name}-{uuid.uuid4().hex}" if work else scratch_path(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def map_batches(df: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """Run ``function`` over Arrow batches as dicts of Python lists; it returns a dict of columns of ``schema``."""
    fields = T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema
    names = fields.names
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)

    return df.mapInArrow(run, fields)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }
    return pa.list_(to_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[kind.simpleString()]


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def words_of(text: Column) -> Column:
    """The words of a text, none for null, as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
