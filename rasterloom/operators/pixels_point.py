"""Point operators on the pixel table: pure projections inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.rounding import byte, half_up, idiv

def background_key(px: DataFrame, color="#ffffff", tolerance=10, smoothing=0) -> DataFrame:
    """Make pixels near the key colour transparent, with an optional soft band."""
    kr, kg, kb = rules.channels(color)
    distance = F.sqrt((F.col("r") - kr) * (F.col("r") - kr) + (F.col("g") - kg) * (F.col("g") - kg) + (F.col("b") - kb) * (F.col("b") - kb))
    limit = max(0, min(100, tolerance)) / 100 * rules.KEY_DISTANCE_SCALE
    band = max(0, min(100, smoothing)) / 100 * rules.KEY_SMOOTHING_SCALE
    alpha = F.when(distance <= limit, F.lit(0))
    if band > 0:
        soft = half_up(F.col("a") * ((distance - F.lit(limit)) / F.lit(band))).cast("int")
        alpha = alpha.when(distance <= limit + band, soft)
    return px.withColumn("a", alpha.otherwise(F.col("a")))


def _mix(px: DataFrame, matrix: list[list[float]]) -> DataFrame:
    rows = [byte(F.col("r") * F.lit(m[0]) + F.col("g") * F.lit(m[1]) + F.col("b") * F.lit(m[2])) for m in matrix]
    return px.withColumns(dict(zip("rgb", rows)))


def adjust_brightness(px: DataFrame, percent: float) -> DataFrame:
    s = percent / 100
    return px.withColumns({c: byte(F.col(c) * F.lit(s)) for c in "rgb"})


def adjust_contrast(px: DataFrame, percent: float) -> DataFrame:
    s = percent / 100
    return px.withColumns({c: byte((F.col(c) - F.lit(127.5)) * F.lit(s) + F.lit(127.5)) for c in "rgb"})


def saturation_matrix(percent: float) -> list[list[float]]:
    s = percent / 100
    return [
        [0.213 + 0.787 * s, 0.715 - 0.715 * s, 0.072 - 0.072 * s],
        [0.213 - 0.213 * s, 0.715 + 0.285 * s, 0.072 - 0.072 * s],
        [0.213 - 0.213 * s, 0.715 - 0.715 * s, 0.072 + 0.928 * s],
    ]


def grayscale_matrix(percent: float) -> list[list[float]]:
    k = 1 - percent / 100
    return [
        [0.2126 + 0.7874 * k, 0.7152 - 0.7152 * k, 0.0722 - 0.0722 * k],
        [0.2126 - 0.2126 * k, 0.7152 + 0.2848 * k, 0.0722 - 0.0722 * k],
        [0.2126 - 0.2126 * k, 0.7152 - 0.7152 * k, 0.0722 + 0.9278 * k],
    ]


def sepia_matrix(percent: float) -> list[list[float]]:
    k = 1 - percent / 100
    return [
        [0.393 + 0.607 * k, 0.769 - 0.769 * k, 0.189 - 0.189 * k],
        [0.349 - 0.349 * k, 0.686 + 0.314 * k, 0.168 - 0.168 * k],
        [0.272 - 0.272 * k, 0.534 - 0.534 * k, 0.131 + 0.869 * k],
    ]


def adjust_saturation(px: DataFrame, percent: float) -> DataFrame:
    return _mix(px, saturation_matrix(percent))


def adjust_grayscale(px: DataFrame, percent: float) -> DataFrame:
    return _mix(px, grayscale_matrix(percent)) if percent > 0 else px


def adjust_sepia(px: DataFrame, percent: float) -> DataFrame:
    return _mix(px, sepia_matrix(percent)) if percent > 0 else px


def adjust_invert(px: DataFrame, on: bool = True) -> DataFrame:
    return px.withColumns({c: F.lit(255) - F.col(c) for c in "rgb"}) if on else px


def luma() -> Column:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return idiv(r * 19595 + g * 38470 + b * 7471 + 32768, 65536).cast("int")


def to_gray(px: DataFrame) -> DataFrame:
    return px.withColumn("gray", luma())


def invert_gray(px: DataFrame) -> DataFrame:
    return px.withColumn("gray", F.lit(255) - luma())


def composite_over(px: DataFrame, color: str | None) -> DataFrame:
    """Source-over on an opaque background; no colour keeps the transparency."""
    if color is None:
        return px
    bg = dict(zip("rgb", rules.channels(color)))
    over = {c: idiv((F.col(c) * F.col("a") + bg[c] * (F.lit(255) - F.col("a"))) * 2 + 255, 510).cast("int") for c in "rgb"}
    return px.withColumns({**over, "a": F.lit(255)})


# ---- per-image aggregates ---------------------------------------------------------------


def image_dims(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )


def with_dims(px: DataFrame) -> DataFrame:
    """Adds ``width`` and ``height`` where a source does not carry them.

    The image scan writes both columns on every pixel (constant runs cost nothing in Parquet),
    so the geometry below needs no join; this aggregate is for tables without them.
    """
    if {"width", "height"} <= set(px.columns):
        return px
    return px.join(image_dims(px), "image_id")


def alpha_extrema(px: DataFrame) -> DataFrame:
    return (
        px.groupBy("image_id")
        .agg(F.min("a").alias("min_alpha"), F.max("a").alias("max_alpha"))
        .withColumn("has_alpha", F.col("min_alpha") < 255)
    )


def color_histogram(px: DataFrame) -> DataFrame:
    """Pixels per colour; partial sums are made before the shuffle."""
    return px.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
