"""Neighbourhood filters on the pixel table.

One shuffle each: pixels go to square tiles (edge pixels also to the tiles beside them), the
data is partitioned by (image, tile), and the row and column windows both run inside that
partitioning. No window sees more than one row or column of one tile, however large the image. Median
and majority need all values of a window at once and run as kernels on tiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.rounding import clamp, idiv, ratio
from rasterloom.functions.scale import by_key
from rasterloom.operators import pixels_point as P
from rasterloom.operators import tile_kernels as K

TILE = 256
KEYS = ("image_id", "_ty", "_tx")


def along_row():
    return Window.partitionBy(*KEYS, "y").orderBy("x")


def along_column():
    return Window.partitionBy(*KEYS, "x").orderBy("y")


def with_halo(px: DataFrame, pad: int, tile: int = TILE) -> DataFrame:
    """Copy each pixel to every tile whose padded box holds it, then partition by tile."""
    def reach(axis: str) -> Column:
        c = F.col(axis)
        return F.sequence(idiv(F.greatest(c - pad, F.lit(0)), tile), idiv(c + pad, tile))

    spread = px.withColumn("_ty", F.explode(reach("y"))).withColumn("_tx", F.explode(reach("x")))
    return by_key(spread, *KEYS)


def core(tiled: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep each pixel only in its own tile."""
    return tiled.filter((idiv(F.col("y"), tile) == F.col("_ty")) & (idiv(F.col("x"), tile) == F.col("_tx"))).drop("_ty", "_tx")


def pack(r="r", g="g", b="b") -> Column:
    return F.shiftleft(F.col(r), 16).bitwiseOR(F.shiftleft(F.col(g), 8)).bitwiseOR(F.col(b))


def unpack(v: Column, channel: str) -> Column:
    return F.shiftright(v, {"r": 16, "g": 8, "b": 0}[channel]).bitwiseAND(F.lit(255))


def _restore(px: DataFrame, made: DataFrame) -> DataFrame:
    return made.select(*px.columns)


def sharpen(px: DataFrame, amount: float, tile: int = TILE) -> DataFrame:
    """3x3 cross; edges repeat, alpha is kept, the result is clamped and rounded half to even."""
    t = with_halo(px, 1, tile).withColumn("_c", pack())
    for name, window, step in (("_l", along_row(), 1), ("_r", along_row(), -1), ("_u", along_column(), 1), ("_d", along_column(), -1)):
        t = t.withColumn(name, F.coalesce(F.lag("_c", step).over(window), F.col("_c")))

    def value(c: str) -> Column:
        around = sum((unpack(F.col(n), c) for n in ("_d", "_l", "_r")), unpack(F.col("_u"), c))
        v = F.col(c) * F.lit(1 + 4 * amount) - F.lit(float(amount)) * around
        return F.bround(clamp(v, 0.0, 255.0), 0).cast("int")

    return _restore(px, core(t, tile).withColumns({c: value(c) for c in "rgb"}))


def median3(px: DataFrame, tile: int = TILE) -> DataFrame:
    """3x3 median per channel, edges repeated."""
    return K.filtered(px, 1, K.median3, tile=tile)


def mode5(px: DataFrame, tile: int = TILE) -> DataFrame:
    """Most common value per channel in the 5x5 window cut at the border.

    Ties go to the smallest value; a best count of two or less leaves the channel unchanged.
    """
    return K.filtered(px, 2, K.mode5, tile=tile)


def blur_weights(sigma: float) -> list[int]:
    """Integer Gaussian weights (65536 at the centre) for distances 0..ceil(3 sigma)."""
    return [math.floor(math.exp(-k * k / (2 * sigma * sigma)) * 65536 + 0.5) for k in range(math.ceil(3 * sigma) + 1)]


def gaussian_blur(px: DataFrame, sigma: float, tile: int = TILE) -> DataFrame:
    """Separable blur, rows then columns, cut at the border and normalised.

    Colours are weighted by alpha; each pass is rounded to 8 bits. Integer weights keep the sums
    exact. All taps of a pass are offsets of one packed value in the same window.
    """
    if sigma <= 0:
        return px
    weights = blur_weights(sigma)
    reach = len(weights) - 1
    t = with_halo(px, reach, tile)
    for window in (along_row(), along_column()):
        packed = F.shiftleft(F.col("a").cast("bigint"), 24).bitwiseOR(pack().cast("bigint"))
        t = t.withColumn("_p", packed)
        taps = {f"_t{d}": (F.lag("_p", -d).over(window), weights[abs(d)]) for d in range(-reach, reach + 1)}
        t = t.withColumns({n: v for n, (v, _) in taps.items()})
        parts = {c: [] for c in ("n", "a", *"rgb")}
        for n, (_, w) in taps.items():
            v = F.col(n)
            wa = F.coalesce(F.shiftright(v, 24) * w, F.lit(0).cast("bigint"))
            parts["n"].append(F.when(v.isNotNull(), F.lit(w).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            parts["a"].append(wa)
            for c in "rgb":
                parts[c].append(F.coalesce(wa * unpack(v, c), F.lit(0).cast("bigint")))
        total, alpha = _added(parts["n"]), _added(parts["a"])
        colour = {c: _added(parts[c]) for c in "rgb"}
        t = t.withColumns({"_n": total, "_na": alpha, **{f"_n{c}": v for c, v in colour.items()}})
        t = t.withColumns(
            {
                "a": ratio(F.col("_na"), F.col("_n")).cast("int"),
                **{
                    c: F.when(F.col("_na") == 0, F.lit(0)).otherwise(ratio(F.col(f"_n{c}"), F.col("_na"))).cast("int")
                    for c in "rgb"
                },
            }
        ).drop("_p", "_n", "_na", "_nr", "_ng", "_nb", *taps)
    return _restore(px, core(t, tile))


def _added(terms: list[Column]) -> Column:
    """Balanced sum, so that long filters do not make a deep expression."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def adjust_chain(px: DataFrame, settings: dict) -> DataFrame:
    """All adjustments in their fixed order; the optional ones only when set."""
    out = P.adjust_brightness(px, settings.get("brightness", 100))
    out = P.adjust_contrast(out, settings.get("contrast", 100))
    out = P.adjust_saturation(out, settings.get("saturation", 100))
    out = P.adjust_grayscale(out, settings.get("grayscale", 0))
    out = P.adjust_sepia(out, settings.get("sepia", 0))
    out = P.adjust_invert(out, settings.get("invert", False))
    out = gaussian_blur(out, settings.get("blur", 0))
    return sharpen(out, settings["sharpen"] / 100) if settings.get("sharpen", 0) > 0 else out
