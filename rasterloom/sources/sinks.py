"""Sinks: renditions as partitioned Parquet, texts as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.files import write_files


def write_renditions(renditions: DataFrame, path: str) -> None:
    """Partitioned by recipe; a rerun replaces the recipes it writes and leaves the others.

    Rows are rebalanced by size before, so that a recipe with most of the rows is written by many
    tasks and small recipes by few."""
    spread = renditions.hint("rebalance", "recipe_id")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recipe_id").parquet(path)


def text_export(texts: DataFrame, path: str, archive: str = "album") -> None:
    """One UTF-8 text file per row, in one folder per archive; a rerun replaces the files it writes."""
    write_files(texts, path, F.col(archive), F.col("text_name"), F.col("text"))


def text_archives(texts: DataFrame, archive: str = "album", prefix: str = "album") -> DataFrame:
    return texts.groupBy(archive).agg(F.count(F.lit(1)).alias("n_texts")).withColumn(
        "archive_name", F.concat(F.lit(f"{prefix}-ocr-"), F.col("n_texts").cast("string"), F.lit("-texts.zip"))
    )
