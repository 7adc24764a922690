"""Name, size and colour rules as column expressions (no Python workers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.rounding import clamp, half_up, idiv, lit

# Formats, extensions and limits that outputs must agree with.
CANVAS_FORMATS = ["image/jpeg", "image/png", "image/webp"]
EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/avif": "avif",
    "image/x-icon": "ico",
}
SERVICE_TYPES = ["image/png", "image/jpeg", "image/jpg", "image/webp"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_UPSCALE_SIDE = 1500
UPSCALE_FACTOR = 4
PREVIEW_SIDE = 480
ICON_MIN, ICON_MAX = 16, 256
ASPECT_PRESETS = {"1:1": (1, 1), "4:3": (4, 3), "16:9": (16, 9)}
LANGUAGE_PATTERN = r"^[a-z]{3}(\+[a-z]{3})*\n?\z"
LAST_EXTENSION = r"\.[^/.]+\z"
KEY_DISTANCE_SCALE = 441.672
KEY_SMOOTHING_SCALE = 180.0


def output_format(mime: Column) -> Column:
    return F.when(mime.isin(CANVAS_FORMATS), mime).otherwise(F.lit("image/png"))


def format_extension(mime: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ext in EXTENSIONS.items():
        out = F.when(mime == name, F.lit(ext)).otherwise(out)
    return out


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, LAST_EXTENSION, "")


def rename_output(file_name: Column, suffix, extension) -> Column:
    return F.concat(stem(file_name), F.lit("-"), lit(suffix), F.lit("."), lit(extension))


def numbered_name(name: Column, k: Column) -> Column:
    """``stem-k.ext`` for k >= 2, split at the last dot; the first use keeps its name."""
    ext = F.regexp_extract(name, r"(?s)(\.[^.]*)\z", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(k <= 1, name).otherwise(F.concat(base, F.lit("-"), k.cast("string"), ext))


def format_bytes(size: Column) -> Column:
    """B, KB with one decimal, MB with two; decimals rounded half up in integer arithmetic."""
    kb = idiv(size * 20 + 1024, 2048)
    mb = idiv(size * 200 + 1048576, 2097152)
    s = lambda c: c.cast("string")
    return (
        F.when(size < 1024, F.concat(s(size), F.lit(" B")))
        .when(size < 1048576, F.concat(s(idiv(kb, 10)), F.lit("."), s(kb % 10), F.lit(" KB")))
        .otherwise(F.concat(s(idiv(mb, 100)), F.lit("."), F.lpad(s(mb % 100), 2, "0"), F.lit(" MB")))
    )


def clamp_quality(quality) -> Column:
    return clamp(lit(quality) / F.lit(100.0), 0.1, 1.0)


def fit_max_side(width: Column, height: Column, max_side) -> tuple[Column, Column]:
    """Both sides unchanged when they fit, else scaled by the longest (may reach 0)."""
    side = lit(max_side)
    fits = (width <= side) & (height <= side)
    scale = side.cast("double") / F.greatest(width, height)
    return (
        F.when(fits, width.cast("bigint")).otherwise(half_up(width * scale)),
        F.when(fits, height.cast("bigint")).otherwise(half_up(height * scale)),
    )


def at_least_one(value: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), half_up(value))


def scale_percent(width: Column, height: Column, percent) -> tuple[Column, Column]:
    s = lit(percent) / F.lit(100.0)
    return at_least_one(width * s), at_least_one(height * s)


def scale_fit(width: Column, height: Column, fit_width, fit_height) -> tuple[Column, Column]:
    s = F.least(
        lit(fit_width).cast("double") / width, lit(fit_height).cast("double") / height, F.lit(1.0)
    )
    return at_least_one(width * s), at_least_one(height * s)


def preview_dims(width: Column, height: Column, max_side: int = PREVIEW_SIDE) -> tuple[Column, Column]:
    s = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))
    return at_least_one(width * s), at_least_one(height * s)


def rotated_dims(width: Column, height: Column, degrees) -> tuple[Column, Column]:
    swap = lit(degrees).isin(90, 270)
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def crop_box(width: Column, height: Column, cx, cy, cw, ch) -> tuple[Column, Column, Column, Column]:
    """Pixel box of a crop given in fractions of the (already rotated) image."""
    x = clamp(half_up(lit(cx) * width), F.lit(0), width - 1)
    y = clamp(half_up(lit(cy) * height), F.lit(0), height - 1)
    w = clamp(half_up(lit(cw) * width), F.lit(1), width - x)
    h = clamp(half_up(lit(ch) * height), F.lit(1), height - y)
    return x, y, w, h


def aspect_factor(width: Column, height: Column, rw: Column, rh: Column) -> Column:
    return (width.cast("double") / height) * (rh.cast("double") / rw)


def centred_crop(k: Column) -> tuple[Column, Column, Column, Column]:
    w = F.when(k <= 1, F.lit(1.0)).otherwise(F.lit(1.0) / k)
    h = F.when(k <= 1, k).otherwise(F.lit(1.0))
    return (F.lit(1.0) - w) / 2, (F.lit(1.0) - h) / 2, w, h


def icon_box(width: Column, height: Column, size) -> tuple[Column, Column, Column, Column, Column]:
    """Icon side, then x, y, width and height of the image drawn inside it."""
    side = clamp(half_up(lit(size).cast("double")), F.lit(ICON_MIN), F.lit(ICON_MAX))
    s = F.least(side.cast("double") / width, side.cast("double") / height)
    dw, dh = at_least_one(width * s), at_least_one(height * s)
    return side, half_up((side - dw) / F.lit(2.0)), half_up((side - dh) / F.lit(2.0)), dw, dh


def margin_side(value, unit: str, width: Column, height: Column) -> Column:
    """One side's thickness; percentages are of the shorter side of the image."""
    v = lit(value).cast("double")
    if unit == "percent":
        v = F.least(width, height) * v / F.lit(100.0)
    return F.greatest(F.lit(0).cast("bigint"), half_up(v))


def hex_value(color: str) -> tuple[int, int, int]:
    """:func:`hex_color` of a constant, worked out while the plan is built."""
    bare = color.replace("#", "", 1)
    if len(bare) == 3:
        bare = "".join(ch * 2 for ch in bare)
    number = re.match(r"\s*([+-]?)(?:0x)?+([0-9a-f]+)", bare, re.IGNORECASE)
    if number is None:
        return 255, 255, 255
    value = int(number[1] + number[2], 16)
    return (value >> 16) & 255, (value >> 8) & 255, value & 255


def channels(color) -> tuple[Column, Column, Column]:
    """Red, green and blue of a constant colour or of a colour column."""
    return tuple(F.lit(v) for v in hex_value(color)) if isinstance(color, str) else hex_color(color)


def hex_color(color: Column) -> tuple[Column, Column, Column]:
    """``#rgb`` / ``#rrggbb`` to channels; leading hex digits count, none at all is white.

    Only the low 32 bits of an over-long number matter, hence the last eight digits.
    """
    at = F.instr(color, "#")
    bare = F.when(
        at > 0, F.concat(F.substring(color, F.lit(1), at - 1), F.substring(color, at + 1, F.length(color)))
    ).otherwise(color)
    three = F.regexp_replace(bare, r"(?s)(.)", "$1$1")
    digits_in = F.when(F.length(bare) == 3, three).otherwise(bare)
    pattern = r"^\s*([+-]?)(?:0[xX])?+([0-9a-fA-F]+)"
    digits = F.regexp_extract(digits_in, pattern, 2)
    value = F.conv(F.substring(digits, -8, 8), 16, 10).cast("bigint")
    signed = F.when(F.regexp_extract(digits_in, pattern, 1) == "-", -value).otherwise(value)
    channel = lambda s: F.when(digits == "", F.lit(255)).otherwise(
        F.shiftright(signed, s).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
    )
    return channel(16), channel(8), channel(0)
