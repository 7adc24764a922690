"""Image files to rows: header columns, pixels, and rejects for undecodable files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.functions.rules import MAX_UPLOAD_BYTES

# Rows of one output batch, so that a large image leaves a task in pieces.
BATCH_PIXELS = 1 << 18


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """Raw files (path, length, content, reason); a file above the limit is listed as ``too_large``, without its content.

    The limit is pushed to the file listing on both sides, so large files are never read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if max_bytes is None:
        return files.withColumn("reason", F.lit(None).cast("string"))
    small = files.filter(F.col("length") <= max_bytes).withColumn("reason", F.lit(None).cast("string"))
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("reason"))
    return small.unionByName(large)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (JVM): image_id, origin, width, height, channels, ok, data."""
    image = spark.read.format("image").load(path).select("image.*")
    return image.select(
        F.xxhash64("origin").alias("image_id"), "origin", "width", "height",
        F.col("nChannels").alias("channels"), (F.col("width") > 0).alias("ok"), "data",
    )


def rejects(scanned: DataFrame) -> DataFrame:
    return scanned.filter("not ok").select("image_id", "origin")


def headers(scanned: DataFrame) -> DataFrame:
    return scanned.filter("ok").select("image_id", "origin", "width", "height", (F.col("channels") == 4).alias("has_alpha"))


def pixels(scanned: DataFrame) -> DataFrame:
    """One row per pixel with the image's size; the decoder's channel order is B, G, R(, A)."""
    def unroll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image_id, width, height, channels, data in pdf.itertuples(index=False):
                raw = np.frombuffer(data, np.uint8).reshape(width * height, channels).astype(np.int32)
                for first in range(0, len(raw), BATCH_PIXELS):
                    part = raw[first : first + BATCH_PIXELS]
                    at = np.arange(first, first + len(part), dtype=np.int32)
                    b, g, r = (part[:, i] for i in ((0, 1, 2) if channels > 1 else (0, 0, 0)))
                    yield pd.DataFrame(
                        {
                            "image_id": np.int64(image_id), "y": at // width, "x": at % width, "r": r, "g": g, "b": b,
                            "a": part[:, 3] if channels == 4 else np.int32(255),
                            "width": np.int32(width), "height": np.int32(height),
                        }
                    )

    return scanned.filter("ok").select("image_id", "width", "height", "channels", "data").mapInPandas(
        unroll, schemas.SIZED_PIXELS
    )
