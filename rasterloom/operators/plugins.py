"""Tools in plug-in form: a tone curve as an iterator kernel, masks and strips as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rasterloom.operators import pixels_geometry, pixels_point
from rasterloom.operators import tools as T


def tone_curve(strength: int = 1):
    """Kernel: darkens middle tones by squaring, ``strength`` times; its table is made once per worker."""
    table = np.arange(256)
    for _ in range(strength):
        table = (table * table + 127) // 255
    table = table.astype(np.int32)

    def curve(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {c: pa.array(table[batch.column(c).to_numpy(zero_copy_only=False)], pa.int32()) for c in "rgb"}

    return curve


@udtf
class Mask:
    """Adds ``mask``: 255 where the luma of a pixel is at least ``level``, else 0."""

    @staticmethod
    def analyze(table: AnalyzeArgument, level: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType(table.dataType.fields).add("mask", IntegerType()))

    def eval(self, table, level: int) -> Iterator[tuple]:
        luma = (299 * table["r"] + 587 * table["g"] + 114 * table["b"]) // 1000
        yield (*table, 255 if luma >= level else 0)


@udtf
class Strips:
    """One row per group and strip of ``height`` pixel lines: bright pixels. State lives from row to row of a group."""

    def __init__(self, *_):
        self.group, self.strip, self.bright = None, None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, height: AnalyzeArgument) -> AnalyzeResult:
        key = next(f for f in table.dataType.fields if f.name == "image_id")
        return AnalyzeResult(StructType([key]).add("strip", IntegerType()).add("bright", LongType()))

    def eval(self, table, height: int) -> Iterator[tuple]:
        strip = table["y"] // height
        if self.strip is not None and strip != self.strip:
            yield self.group, self.strip, self.bright
            self.bright = 0
        self.group, self.strip = table["image_id"], strip
        self.bright += table["mask"] == 255

    def terminate(self) -> Iterator[tuple]:
        if self.strip is not None:
            yield self.group, self.strip, self.bright


def register_all() -> None:
    """The plug-ins of this package, each once."""
    known = set(T.registered())
    for name, transform in (
        ("remove-background", pixels_point.background_key), ("sepia", pixels_point.adjust_sepia), ("margin", pixels_geometry.margin_paint)):
        if name not in known:
            T.register_tool(name, transform)
    if "tone" not in known:
        T.register_kernel("tone", tone_curve, "r int, g int, b int")
        T.register_table_function("mask", Mask)
        T.register_table_function("strips", Strips, ("image_id",), ("y", "x"))
