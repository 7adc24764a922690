"""Intake guards and list appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.scale import BLOCK_ROWS, numbered

# The messages shown for a rejected or failed file.
REJECT_MESSAGES = {
    "unsupported_type": "Unsupported image type. Use PNG, JPEG, or WebP.",
    "empty": "Empty upload.",
    "too_large": "Image exceeds the 10 MB limit.",
    "side_too_long": "Image is too large to upscale. The longest side must be at most 1500px.",
}


def reject_reason(mime: Column, size: Column, fold_case: bool = False) -> Column:
    """Null for an accepted file, else the first reason: type, emptiness, size."""
    kind = F.lower(mime) if fold_case else mime
    return (
        F.when(~F.coalesce(kind.isin(rules.SERVICE_TYPES), F.lit(False)), F.lit("unsupported_type"))
        .when(F.coalesce(size, F.lit(0)) == 0, F.lit("empty"))
        .when(size > rules.MAX_UPLOAD_BYTES, F.lit("too_large"))
    )


def intake_guard(images: DataFrame, fold_case: bool = False) -> DataFrame:
    """Adds ``reason`` (null = accepted) and its HTTP ``status``."""
    return images.withColumn("reason", reject_reason(F.col("mime"), F.col("size_bytes"), fold_case)).withColumn(
        "status",
        F.when(F.col("reason") == "too_large", F.lit(413)).when(F.col("reason").isNotNull(), F.lit(400)),
    )


def accepted(guarded: DataFrame) -> DataFrame:
    return guarded.filter("reason is null").drop("reason", "status")


def rejected(guarded: DataFrame) -> DataFrame:
    return guarded.filter("reason is not null")


def upscale_guard(images: DataFrame) -> DataFrame:
    """Adds ``too_big`` for images whose longest side is above the upscale limit."""
    return images.withColumn("too_big", F.greatest("width", "height") > F.lit(rules.MAX_UPSCALE_SIDE))


def append_cap(
    batches: DataFrame, cap: int | None, rows_per_block: int = BLOCK_ROWS, numbered_above: int = 1000
) -> DataFrame:
    """List content per album after appending ``batch`` after ``batch`` (each ordered by ``pos``).

    No cap keeps everything, duplicates included. A cap of 1 replaces the list by the first
    file of the latest batch. Any other cap keeps the first ``cap`` files. For caps up to
    ``numbered_above`` the rank filter is applied before the shuffle as well, so a hot album sends
    only ``cap`` rows per task; above, files are numbered block by block first.
    """
    if cap is None or cap > max(1, numbered_above):
        block = F.struct(F.col("batch"), F.floor(F.col("pos") / rows_per_block))
        listed = numbered(batches, ["album"], ["batch", "pos"], block, "list_pos")
        return listed if cap is None else listed.filter(F.col("list_pos") <= cap)
    order = [F.col("batch").desc(), F.col("pos")] if cap == 1 else [F.col("batch"), F.col("pos")]
    rank = F.row_number().over(Window.partitionBy("album").orderBy(*order))
    return batches.withColumn("list_pos", rank).filter(F.col("list_pos") <= cap)


def append_all(batches: list[DataFrame]) -> DataFrame:
    """Union of the batches in arrival order, numbered by ``batch``."""
    numbered_batches = [df.withColumn("batch", F.lit(i)) for i, df in enumerate(batches)]
    return reduce(DataFrame.unionByName, numbered_batches)
