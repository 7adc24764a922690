"""Append-only intake as a stream: new files are guarded and appended, nothing is merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rasterloom.operators.intake import intake_guard


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def table_stream(spark: SparkSession, folder: str, schema: StructType | str, table: str) -> DataFrame:
    """The stream of a table that is one file of ``folder``, or a folder of files in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return file_stream(spark, f"{folder}/{table}", schema, "*.parquet")
    return file_stream(spark, folder, schema, table)


def incremental_intake(
    arrivals: DataFrame, to_images: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Guard what has arrived since the last run and append it, accepted or not, with its reason.

    The guard keeps no state, so the stream needs neither a watermark nor a shuffle; the file
    sink's log and the checkpoint make each file count once, also after a failure.
    """
    return (
        intake_guard(to_images(arrivals)).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
