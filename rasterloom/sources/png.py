"""Writes small PNG files from the pixel table, so that the image scan has files to read."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.functions.ship import ship_package
from rasterloom.sources.files import write_files


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """8-bit RGBA PNG without filters."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_pngs(px: DataFrame, folder: str) -> None:
    """One file per image of the (small) pixel table."""
    ship_package(px.sparkSession)

    def encoded(key, pdf):
        pdf = pdf.sort_values(["y", "x"])
        width, height = int(pdf.x.max()) + 1, int(pdf.y.max()) + 1
        return pd.DataFrame({"name": [f"{int(key[0])}.png"], "content": [encode(width, height, pdf[["r", "g", "b", "a"]].to_numpy("uint8").tobytes())]})

    images = stored(px.groupBy("image_id").applyInPandas(encoded, "name string, content binary"), "encoded")
    write_files(images, folder, F.lit("images"), F.col("name"), F.col("content"))
