"""Metadata audit: tag rows, readable summary, totals before and after stripping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.functions.ship import ship_package
from rasterloom.operators.runner import ToolError
from rasterloom.sources import exif as reader

# Tags and their labels in order.
TAGS = {
    "description": 0x010E, "make": 0x010F, "model": 0x0110, "orientation": 0x0112, "software": 0x0131,
    "date": 0x0132, "artist": 0x013B, "copyright": 0x8298, "original_date": 0x9003,
}
LABELS = ["Camera", "Taken", "Software", "Author", "Copyright", "Description", "Orientation", "GPS location"]


def exif_scan(files: DataFrame, header_bytes: int | None = None) -> DataFrame:
    """Tag rows of JPEG files (image_id, mime, content); anything malformed has no rows.

    Non-JPEG files and files that do not start like one are left out on the JVM side, before bytes
    reach a Python worker. Files are read whole unless ``header_bytes`` says how much to look at.
    """
    ship_package(files.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *tag) for i, data in zip(pdf.image_id, pdf.content) for tag in reader.read_tags(bytes(data))]
            out = pd.DataFrame(rows, columns=["image_id", "ifd", "tag", "text", "num"])
            yield out.astype({"image_id": "int64", "tag": "int32", "num": "Int64"})

    head = F.col("content") if header_bytes is None else F.substring("content", 1, header_bytes)
    heads = files.filter(F.col("mime") == "image/jpeg").select("image_id", head.alias("content")).filter(F.hex(F.substring("content", 1, 2)) == "FFD8")
    return heads.mapInPandas(parse, schemas.EXIF_TAGS)


def exif_summary(tags: DataFrame) -> DataFrame:
    """(image_id, ord, label, value): what a reader would want to know, empty values left out."""
    def pick(name: str, ifd: str, kind: str) -> Column:
        return F.max(F.when((F.col("ifd") == ifd) & (F.col("tag") == TAGS[name]), F.col(kind)))

    texts = ["description", "make", "model", "software", "date", "artist", "copyright"]
    wide = tags.groupBy("image_id").agg(
        *[pick(t, "ifd0", "text").alias(t) for t in texts],
        pick("orientation", "ifd0", "num").alias("orientation"),
        pick("original_date", "exif", "text").alias("original_date"),
        F.max(F.col("ifd") == "gps").alias("gps"),
    )
    turned = F.when(
        F.col("orientation") > 1,
        F.concat(F.lit("Stored rotated/flipped (EXIF orientation "), F.col("orientation").cast("string"), F.lit(")")),
    )
    values = [
        F.concat_ws(" ", "make", "model"), F.coalesce("original_date", "date"), F.col("software"), F.col("artist"),
        F.col("copyright"), F.col("description"), turned, F.when(F.col("gps"), F.lit("Embedded in the file")),
    ]
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(zip(LABELS, values))]
    return wide.select("image_id", F.explode(F.array(*entries)).alias("e")).select("image_id", "e.*").filter(
        F.col("value").isNotNull() & (F.col("value") != "")
    )


def strip_metadata(images: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean catalogue rows and the tags that are left (those of other images)."""
    from_pixels = images.select("image_id", "album", "pos", "file_name", "mime", "width", "height")
    return from_pixels, tags.join(images.select("image_id"), "image_id", "left_anti")


def privacy_audit(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Images per label, before and (if given) after stripping. An image has a label once."""
    rows = before.select("label", F.lit(1).alias("b"), F.lit(0).alias("a"))
    if after is not None:
        rows = rows.unionByName(after.select("label", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return rows.groupBy("label").agg(F.sum("b").alias("images_before"), F.sum("a").alias("images_after"))


def orientations(tags: DataFrame) -> DataFrame:
    """(image_id, orientation) for the orientation operator; 1 where the tag is absent is implied."""
    return tags.filter((F.col("ifd") == "ifd0") & (F.col("tag") == TAGS["orientation"])).select(
        "image_id", F.col("num").cast("int").alias("orientation")
    )


def metadata_remover():
    """File kernel (see :mod:`rasterloom.operators.runner`): the same JPEG without its metadata segments."""
    def remove(file: dict) -> dict:
        try:
            data = reader.without_metadata(bytes(file["content"]))
        except ValueError as broken:
            raise ToolError(str(broken)) from broken
        return {"output": data, "out_bytes": len(data)}

    return remove
