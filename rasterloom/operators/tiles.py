"""Tiles of large images and tiled model inference."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.rounding import idiv, lit
from rasterloom.functions.scale import by_key
from rasterloom.functions.ship import ship_package

# Tile side and padding of the upscaler.
TILE, PAD = 256, 16
FACTOR = rules.UPSCALE_FACTOR


def tile_grid(sizes: DataFrame, tile: int = TILE, pad: int = PAD) -> DataFrame:
    """Core and padded box of every tile, and the core's offset in the enlarged padded tile."""
    step = lambda n: F.sequence(F.lit(0), idiv(n - 1, tile).cast("int"))
    grid = sizes.withColumn("ty", F.explode(step(F.col("height")))).withColumn("tx", F.explode(step(F.col("width"))))
    single = F.greatest(F.col("width"), F.col("height")) <= tile
    p = F.when(single, F.lit(0)).otherwise(F.lit(pad))
    zero = F.lit(0)
    return (
        grid.withColumns({"y0": F.col("ty") * tile, "x0": F.col("tx") * tile})
        .withColumns({"y1": F.least(F.col("y0") + tile, F.col("height")), "x1": F.least(F.col("x0") + tile, F.col("width"))})
        .withColumns(
            {
                "py0": F.greatest(F.col("y0") - p, zero), "px0": F.greatest(F.col("x0") - p, zero),
                "py1": F.least(F.col("y1") + p, F.col("height")), "px1": F.least(F.col("x1") + p, F.col("width")),
            }
        )
        .withColumns({"oy0": (F.col("y0") - F.col("py0")) * FACTOR, "ox0": (F.col("x0") - F.col("px0")) * FACTOR})
    )


def tile_explode(px: DataFrame, tile: int = TILE, pad: int = PAD) -> DataFrame:
    """Each pixel once per padded tile that holds it (four at most while pad <= tile / 2)."""
    single = F.greatest(F.col("width"), F.col("height")) <= tile

    def reach(axis: str, size: Column) -> Column:
        c = F.col(axis)
        low = idiv(F.greatest(c - pad, F.lit(0)), tile)
        high = idiv(F.least(c + pad, size - 1), tile)
        own = idiv(c, tile)
        return F.sequence(F.when(single, own).otherwise(low), F.when(single, own).otherwise(high))

    spread = px.withColumn("ty", F.explode(reach("y", F.col("height")))).withColumn("tx", F.explode(reach("x", F.col("width"))))
    return spread.withColumns({"ty": F.col("ty").cast("int"), "tx": F.col("tx").cast("int")})


def tile_stitch(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Drop the padding again: each pixel from its own tile only."""
    return tiles.filter(
        (idiv(F.col("y"), lit(tile)) == F.col("ty")) & (idiv(F.col("x"), lit(tile)) == F.col("tx"))
    ).drop("ty", "tx")


def nearest_model() -> Callable[[np.ndarray], np.ndarray]:
    """Stand-in model: repeats every pixel 4 x 4 (height x width x 3 floats in 0..1)."""
    return lambda img: img.repeat(FACTOR, axis=0).repeat(FACTOR, axis=1)


_LOADED: dict = {}


def _model(loader, token: str):
    """Load a model once per Python worker and call of :func:`tiled_inference`; only the last one is kept."""
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = loader()
    return _LOADED[token]


def _lanczos_matrix(size: int) -> np.ndarray:
    """Integer Lanczos-3 weights (rows = target cells) for a whole-factor enlargement."""
    at = (2 * np.arange(size * FACTOR)[:, None] + 1) / (2.0 * FACTOR) - (np.arange(size)[None, :] + 0.5)
    p = at * 3.141592653589793
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(at == 0, 1.0, 3.0 * np.sin(p) * np.sin(p / 3.0) / (p * p))
    v[np.abs(at) >= 3] = 0.0
    return np.floor(v * 65536 + 0.5)


def _enlarge_alpha(alpha: np.ndarray) -> np.ndarray:
    """Alpha x 4, columns then rows, clamped and rounded to 8 bits after each pass."""
    for axis in (1, 0):
        weights = _lanczos_matrix(alpha.shape[axis])
        sums = alpha @ weights.T if axis == 1 else weights @ alpha
        total = weights.sum(axis=1)
        total = total[None, :] if axis == 1 else total[:, None]
        alpha = np.minimum(255, np.floor((2 * np.maximum(sums, 0) + total) / (2 * total)))
    return alpha


def tiled_inference(px: DataFrame, loader=nearest_model, tile: int = TILE, pad: int = PAD) -> DataFrame:
    """Enlarge images 4x with a model, tile by tile, and stitch the cores.

    The padded tiles are the groups, so a task holds (tile + 2 pad) squared pixels at most, for
    any image size. ``loader`` returns the predict function and runs once per Python worker.
    Alpha is carried by Lanczos in the same pass: its reach of three pixels lies inside the
    padding, and without padding the tile is the whole image.
    """
    if pad < 3:
        raise ValueError("the padding must cover the reach of the alpha filter (3 pixels)")

    ship_package(px.sparkSession)
    token = uuid.uuid4().hex

    def enlarge(key, pdf):
        image_id, ty, tx = (int(k) for k in key)
        pdf = pdf.sort_values(["y", "x"])
        rows, columns = pdf.y.to_numpy(), pdf.x.to_numpy()
        shape = (rows[-1] - rows[0] + 1, columns[-1] - columns[0] + 1)
        width, height = int(pdf.width.iloc[0]), int(pdf.height.iloc[0])
        rgb = pdf[["r", "g", "b"]].to_numpy(np.float32).reshape(*shape, 3) / 255.0
        up = np.clip(_model(loader, token)(rgb), 0.0, 1.0)
        alpha = _enlarge_alpha(pdf["a"].to_numpy(np.float64).reshape(shape))
        # Only what belongs to the tile itself stays of its enlarged surroundings.
        own_y, own_x = (np.repeat(axis[0] + np.arange(n), FACTOR) // tile == t for axis, n, t in ((rows, shape[0], ty), (columns, shape[1], tx)))
        ys, xs = (slice(*np.flatnonzero(own)[[0, -1]] + [0, 1]) for own in (own_y, own_x))
        out = (up[ys, xs] * 255.0 + 0.5).astype(np.int32)
        yy, xx = np.mgrid[ys, xs]
        yy, xx = yy + rows[0] * FACTOR, xx + columns[0] * FACTOR
        return pd.DataFrame(
            {
                "image_id": image_id, "y": yy.ravel(), "x": xx.ravel(),
                "r": out[..., 0].ravel(), "g": out[..., 1].ravel(), "b": out[..., 2].ravel(),
                "a": alpha[ys, xs].astype(np.int32).ravel(), "width": width * FACTOR, "height": height * FACTOR,
            }
        )

    schema = "image_id bigint, y int, x int, r int, g int, b int, a int, width int, height int"
    tiles = tile_explode(px.select("image_id", "y", "x", *"rgba", "width", "height"), tile, pad)
    return by_key(tiles, "image_id", "ty", "tx").groupBy("image_id", "ty", "tx").applyInPandas(enlarge, schema)
