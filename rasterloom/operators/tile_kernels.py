"""Filters as kernels on padded tiles: one shuffle of the pixels, then array work on one tile at a time.

A pixel goes to its own tile and to those whose padding holds it. A tile becomes a plane per channel with a mask of
the pixels that exist; a kernel makes new planes of it, and only the tile's own pixels leave. A task holds one tile,
whatever the size of the image.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.functions.rounding import idiv
from rasterloom.functions.scale import by_key
from rasterloom.functions.ship import ship_package

TILE = 256


def padded(px: DataFrame, pad: int, tile: int, keys: tuple[str, ...]) -> DataFrame:
    """Each pixel once per padded tile that holds it, partitioned by tile."""
    def reach(axis: str) -> Column:
        c = F.col(axis)
        return F.sequence(idiv(F.greatest(c - pad, F.lit(0)), tile), idiv(c + pad, tile))

    spread = px.withColumn("_ty", F.explode(reach("y"))).withColumn("_tx", F.explode(reach("x")))
    return by_key(spread.withColumns({c: F.col(c).cast("int") for c in ("_ty", "_tx")}), *keys, "_ty", "_tx")


class Tile:
    """Planes of the padded tile ``(ty, tx)``; ``y0, x0`` is the place of its first cell."""

    def __init__(self, rows: pa.Table, tile: int, channels: str):
        self.y, self.x = (rows.column(c).to_numpy().astype(np.int64) for c in "yx")
        self.y0, self.x0 = int(self.y.min()), int(self.x.min())
        shape = (int(self.y.max()) - self.y0 + 1, int(self.x.max()) - self.x0 + 1)
        self.cell = (self.y - self.y0, self.x - self.x0)
        self.there = np.zeros(shape, bool)
        self.there[self.cell] = True
        self.planes = {}
        for c in channels:
            self.planes[c] = np.zeros(shape, np.int64)
            self.planes[c][self.cell] = rows.column(c).to_numpy()
        ty, tx = rows.column("_ty")[0].as_py(), rows.column("_tx")[0].as_py()
        self.own = (self.y // tile == ty) & (self.x // tile == tx)
        # Rows and columns of the planes that belong to the tile itself.
        self.rows = slice(max(0, ty * tile - self.y0), min(shape[0], (ty + 1) * tile - self.y0))
        self.columns = slice(max(0, tx * tile - self.x0), min(shape[1], (tx + 1) * tile - self.x0))


def filtered(px: DataFrame, pad: int, kernel: Callable[[Tile], dict[str, np.ndarray]], channels: str = "rgb", tile: int = TILE, keys=("image_id",)) -> DataFrame:
    """``px`` with the channels that ``kernel`` returns as planes; all other columns stay with their pixel."""
    ship_package(px.sparkSession)
    schema, names = to_arrow_schema(px.schema), px.columns

    def run(rows: pa.Table) -> pa.Table:
        t = Tile(rows, tile, channels)
        made = kernel(t)
        own = rows.select(names).filter(pa.array(t.own))
        at = tuple(v[t.own] for v in t.cell)
        return pa.table({f.name: pa.array(made[f.name][at], f.type) if f.name in made else own.column(f.name) for f in schema}, schema)

    return padded(px, pad, tile, keys).groupBy(*keys, "_ty", "_tx").applyInArrow(run, px.schema)


def shifted(plane: np.ndarray, dy: int, dx: int, outside) -> np.ndarray:
    """``plane[y + dy, x + dx]`` for every cell, ``outside`` beyond the border."""
    out = np.full_like(plane, outside)
    height, width = plane.shape
    if abs(dy) < height and abs(dx) < width:
        out[max(0, -dy) : height - max(0, dy), max(0, -dx) : width - max(0, dx)] = plane[max(0, dy) : height + min(0, dy), max(0, dx) : width + min(0, dx)]
    return out


def median3(t: Tile) -> dict[str, np.ndarray]:
    """Median of 3 x 3 cells: a missing neighbour in the line counts as the cell, a missing line as the cell's own."""
    sides = {d: shifted(t.there, 0, d, False) for d in (-1, 1)}
    lines = {d: shifted(t.there, d, 0, False) for d in (-1, 1)}
    out = {}
    for c in "rgb":
        p = t.planes[c].astype(np.uint8)
        line = [np.where(sides[-1], shifted(p, 0, -1, 0), p), p, np.where(sides[1], shifted(p, 0, 1, 0), p)]
        nine = line + [np.where(lines[d], shifted(v, d, 0, 0), v) for d in (-1, 1) for v in line]
        out[c] = np.partition(np.stack(nine), 4, axis=0)[4]
    return out


def mode5(t: Tile) -> dict[str, np.ndarray]:
    """Most common value of 5 x 5 cells by sliding histograms, one per line, which gain a column and lose one at a time.

    Ties go to the smallest value; a best count of two or less changes nothing.
    """
    height, width = t.there.shape
    lines = np.arange(t.rows.start, t.rows.stop)
    out = {}
    for c in "rgb":
        p, made = t.planes[c], t.planes[c].copy()
        counts = np.zeros((len(lines), 256), np.uint8)

        def move(column: int, by: int) -> None:
            for d in range(-2, 3):
                at = lines + d
                inside = np.flatnonzero((at >= 0) & (at < height))
                inside = inside[t.there[at[inside], column]]
                counts[inside, p[at[inside], column]] += np.uint8(by % 256)

        first = max(0, t.columns.start - 2)
        for column in range(first, min(width, t.columns.start + 2)):
            move(column, 1)
        for column in range(t.columns.start, t.columns.stop):
            if column + 2 < width:
                move(column + 2, 1)
            if column - 3 >= first:
                move(column - 3, -1)
            best = counts.argmax(1)
            often = counts[np.arange(len(lines)), best] > 2
            made[lines[often], column] = best[often]
        out[c] = made
    return out


# ---- enlarging ---------------------------------------------------------------------------

LANCZOS_REACH, LANCZOS_ONE = 3, 65536


def lanczos_weights(sources: np.ndarray, targets: np.ndarray, factor: int) -> np.ndarray:
    """Integer Lanczos-3 weights, a row per target cell; ``factor`` target cells make a source cell."""
    gap = (targets[:, None] * 2 + 1) / (factor * 2.0) - (sources[None] + 0.5)
    angle = gap * math.pi
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(gap == 0, 1.0, 3.0 * np.sin(angle) * np.sin(angle / 3.0) / (angle * angle))
    value[np.abs(gap) >= LANCZOS_REACH] = 0.0
    return np.floor(value * LANCZOS_ONE + 0.5)


def _rounded(sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums over weights as 8 bits, half up; whole numbers in doubles are exact here."""
    return np.minimum(255, np.floor_divide(2 * np.maximum(sums, 0) + total, 2 * total))


def enlarged_tile(t: Tile, factor: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Lines, columns and channels of the tile's own cells, ``factor`` times as many along each side; x first, then y."""
    a = t.planes["a"]
    planes = [(2 * t.planes[c] * a + 255) // 510 for c in "rgb"] + [a]
    targets = [np.arange((first + s.start) * factor, (first + s.stop) * factor) for first, s in ((t.y0, t.rows), (t.x0, t.columns))]
    down, across = (lanczos_weights(first + np.arange(n), at, factor) for first, n, at in zip((t.y0, t.x0), t.there.shape, targets))
    # Cells that don't exist have no weight, which differs from line to line only where a tile has holes.
    there = t.there.astype(np.float64)
    beside = there @ across.T
    lines = beside > 0
    below = down @ lines
    made = []
    for p in planes:
        wide = np.where(lines, _rounded(p.astype(np.float64) @ across.T, np.where(lines, beside, 1)), 0)
        made.append(_rounded(down @ wide, np.where(below > 0, below, 1)).astype(np.int64))
    back = [np.where(made[3] == 0, 0, np.minimum(255, p * 255 // np.maximum(made[3], 1))) for p in made[:3]]
    return targets[0], targets[1], dict(zip("rgba", [*back, made[3]]))


def enlarged(px: DataFrame, factor: Column, tile: int = TILE // 2, keys=("image_id",)) -> DataFrame:
    """Enlarges images by a whole factor each. Columns that are neither place, size nor channel are the image's (one value each)."""
    ship_package(px.sparkSession)
    schema, names = to_arrow_schema(px.schema), px.columns

    def run(rows: pa.Table) -> pa.Table:
        t, times = Tile(rows, tile, "rgba"), rows.column("_factor")[0].as_py()
        lines, columns, made = enlarged_tile(t, times)
        n = len(lines) * len(columns)
        made = {c: v.ravel() for c, v in made.items()} | {"y": np.repeat(lines, len(columns)), "x": np.tile(columns, len(lines))}
        made |= {c: np.full(n, rows.column(c)[0].as_py() * times) for c in ("width", "height")}
        first = rows.slice(0, 1).select(names).combine_chunks()
        repeat = lambda c: first.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        return pa.table({f.name: pa.array(made[f.name], f.type) if f.name in made else repeat(f.name) for f in schema}, schema)

    tiled = padded(px.withColumn("_factor", factor.cast("int")), LANCZOS_REACH, tile, keys)
    return tiled.groupBy(*keys, "_ty", "_tx").applyInArrow(run, px.schema)
