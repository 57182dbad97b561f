"""Row-wise operators on streams, and running a stream over what a folder holds now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.operators.licenses import detect_license
from millrace.session import scratch_path


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str, files_per_batch: int = 1000) -> DataFrame:
    """Files below a folder whose names match ``glob``. A plain name is a table in the folder: a file, or a folder of files of any names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if set(glob) & set("*?[]{}\\"):
        return reader.option("pathGlobFilter", glob).parquet(folder)
    # spelled as a pattern, since the path of a stream may stand for one file only as a pattern
    return reader.parquet(f"{folder}/{glob[:-1]}[{glob[-1]}]")


def stream_classify(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Licence classification of a stream of texts: the batch operator as it is, being a projection."""
    return detect_license(stream, text_col)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into parquet below the shared folder; the written result as a frame."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream
        .writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
