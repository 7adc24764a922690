"""Geometry on the sized pixel table (pixels with ``width`` and ``height``).

Moves, crops, frames and orientations are projections: each pixel knows its image's size, so
there is no join and no shuffle. Only smooth resampling shuffles, once, on the target cell,
after partial sums per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.rounding import clamp, idiv, lit, ratio
from rasterloom.operators.pixels_point import composite_over
from rasterloom.operators.tile_kernels import enlarged

KEYS = ("image_id",)


def _moved(px: DataFrame, x: Column, y: Column, width: Column, height: Column) -> DataFrame:
    new = {"x": x, "y": y, "width": width, "height": height}
    return px.select(*[new[c].cast("int").alias(c) if c in new else F.col(c) for c in px.columns])


def rotate_flip(px: DataFrame, degrees=0, flip_h: bool = False, flip_v: bool = False) -> DataFrame:
    """Flip the source, then rotate it clockwise by 0, 90, 180 or 270 degrees."""
    x = F.col("width") - 1 - F.col("x") if flip_h else F.col("x")
    y = F.col("height") - 1 - F.col("y") if flip_v else F.col("y")
    turned = {
        0: (x, y, F.col("width"), F.col("height")),
        90: (F.col("height") - 1 - y, x, F.col("height"), F.col("width")),
        180: (F.col("width") - 1 - x, F.col("height") - 1 - y, F.col("width"), F.col("height")),
        270: (y, F.col("width") - 1 - x, F.col("height"), F.col("width")),
    }[degrees]
    return _moved(px, *turned)


def orient_normalize(px: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Upright pixels from the stored EXIF orientation 1..8 (others count as 1)."""
    o = F.col(orientation)
    x = (
        F.when(o.isin(2, 3), F.col("width") - 1 - F.col("x")).when(o == 5, F.col("y")).when(o == 6, F.col("height") - 1 - F.col("y"))
        .when(o == 7, F.col("height") - 1 - F.col("y")).when(o == 8, F.col("y")).otherwise(F.col("x"))
    )
    y = (
        F.when(o.isin(3, 4), F.col("height") - 1 - F.col("y")).when(o.isin(5, 6), F.col("x")).when(o.isin(7, 8), F.col("width") - 1 - F.col("x")).otherwise(F.col("y"))
    )
    swap = o.isin(5, 6, 7, 8)
    return _moved(px, x, y, F.when(swap, F.col("height")).otherwise(F.col("width")), F.when(swap, F.col("width")).otherwise(F.col("height"))).drop(orientation)


def crop_pixels(px: DataFrame, cx, cy, cw, ch) -> DataFrame:
    """Keep the box given in fractions of the image and shift it to the origin."""
    x0, y0, w, h = rules.crop_box(F.col("width"), F.col("height"), cx, cy, cw, ch)
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return _moved(px.filter(inside), F.col("x") - x0, F.col("y") - y0, w, h)


def _targets(src: Column, size: Column, target: Column) -> Column:
    """Target cells that source cell ``src`` contributes to along one axis."""
    shrink = F.sequence(idiv(src * target, size), idiv((src + 1) * target - 1, size))
    first = F.floor((target * (src * 2 - 1) - size) / (size * 2)) + 1
    last = F.ceil((target * (src * 2 + 3) - size) / (size * 2)) - 1
    top = target - 1
    grow = F.sequence(clamp(first, F.lit(0).cast("bigint"), top), clamp(last, F.lit(0).cast("bigint"), top))
    return F.when(target <= size, shrink).otherwise(grow)


def _weight(src: Column, cell: Column, size: Column, target: Column) -> Column:
    """Integer weight: overlap when shrinking, distance to the centre when growing."""
    overlap = F.least((src + 1) * target, (cell + 1) * size) - F.greatest(src * target, cell * size)
    near = target * 2 - F.abs((cell * 2 + 1) * size - target * (src * 2 + 1))
    return F.greatest(F.lit(0).cast("bigint"), F.when(target <= size, overlap).otherwise(near))


def resample(px: DataFrame, width, height, method: str = "smooth", keys=KEYS) -> DataFrame:
    """Scale to ``width`` x ``height`` (columns or numbers).

    Smooth: area average where an axis shrinks, bilinear where it grows, colours weighted by
    alpha. Every source pixel is sent to the cells it touches with an integer weight, so the
    sums are exact and do not depend on the order of the rows. Nearest: no shuffle at all.
    """
    big = lambda c: lit(c).cast("bigint")
    carried = [c for c in px.columns if c not in {*keys, *"xyrgba", "width", "height", "_tw", "_th"}]
    src = px.withColumns({"_tw": big(width), "_th": big(height), "_sx": big(F.col("x")), "_sy": big(F.col("y")),
                          "_sw": big(F.col("width")), "_sh": big(F.col("height"))})
    sx, sy, sw, sh, tw, th = (F.col(c) for c in ("_sx", "_sy", "_sw", "_sh", "_tw", "_th"))
    if method == "nearest":
        cells = lambda s, n, t: F.sequence(
            idiv(s * t, n), F.least(t - 1, idiv((s + 1) * t, n))
        )
        spread = (
            src.withColumn("_x", F.explode(cells(sx, sw, tw)))
            .filter(idiv((F.col("_x") * 2 + 1) * sw, tw * 2) == sx)
            .withColumn("_y", F.explode(cells(sy, sh, th)))
            .filter(idiv((F.col("_y") * 2 + 1) * sh, th * 2) == sy)
        )
        moved = {"x": F.col("_x"), "y": F.col("_y"), "width": tw, "height": th}
        return spread.select(*[moved[c].cast("int").alias(c) if c in moved else F.col(c) for c in px.columns])

    spread = (
        src.withColumn("_x", F.explode(_targets(sx, sw, tw)))
        .withColumn("_wx", _weight(sx, F.col("_x"), sw, tw))
        .withColumn("_y", F.explode(_targets(sy, sh, th)))
        .withColumn("_w", F.col("_wx") * _weight(sy, F.col("_y"), sh, th))
        .filter("_w > 0")
    )
    wa = F.col("_w") * F.col("a")
    sums = spread.groupBy(*keys, *carried, "_tw", "_th", "_y", "_x").agg(
        F.sum("_w").alias("_n"), F.sum(wa).alias("_na"),
        *[F.sum(wa * F.col(c)).alias(f"_n{c}") for c in "rgb"],
    )
    colour = lambda c: F.when(F.col("_na") == 0, F.lit(0)).otherwise(
        ratio(F.col(f"_n{c}"), F.col("_na"))
    )
    made = {
        "x": F.col("_x"), "y": F.col("_y"), "width": tw, "height": th,
        "a": ratio(F.col("_na"), F.col("_n")), **{c: colour(c) for c in "rgb"},
    }
    return sums.select(*[made[c].cast("int").alias(c) if c in made else F.col(c) for c in px.columns])


def resample_lanczos(px: DataFrame, factor, keys=KEYS) -> DataFrame:
    """Enlarge by a whole factor (number or column) with Lanczos-3, x then y, on alpha-premultiplied channels.

    Weights are integers, so the sums are exact. Every tile with its padding is multiplied by two small weight
    matrices (see :mod:`tile_kernels`), after one shuffle of the source pixels. Factor 1 changes nothing and shuffles nothing.
    """
    if isinstance(factor, int):
        return px if factor == 1 else enlarged(px, lit(factor), keys=tuple(keys))
    return px.filter(factor == 1).unionByName(enlarged(px.filter(factor != 1), factor, keys=tuple(keys)))


def thumbnail(px: DataFrame, max_side: int = 128) -> DataFrame:
    """Shrink so that both sides fit; smaller images are left alone."""
    w, h = rules.fit_max_side(F.col("width"), F.col("height"), max_side)
    one = F.lit(1).cast("bigint")
    fits = F.greatest("width", "height") <= max_side
    return px.filter(fits).unionByName(resample(px.filter(~fits), F.greatest(one, w), F.greatest(one, h)))


def edit_image(px: DataFrame, degrees=0, flip_h=False, flip_v=False, crop=(0, 0, 1, 1), width=None, height=None) -> DataFrame:
    """Rotate/flip, crop and resize; the first two fold into one projection and filter.

    A side that is not given keeps the length it has after the crop.
    """
    cut = crop_pixels(rotate_flip(px, degrees, flip_h, flip_v), *crop)
    if width is None and height is None:
        return cut
    side = lambda given, own: F.col(own).cast("bigint") if given is None else rules.at_least_one(lit(given).cast("double"))
    return resample(cut, side(width, "width"), side(height, "height"))


def frame(px: DataFrame, left, top, right, bottom, rgba: dict) -> DataFrame:
    """Surround the image by a border of one colour.

    Border pixels grow outward: a pixel on an edge also emits the frame cells beside it, so the
    frame is made where the pixels are, each cell exactly once, without a grid or a join.
    """
    l, t, r, b = (lit(v).cast("int") for v in (left, top, right, bottom))
    xs = F.sequence(F.when(F.col("x") == 0, -l).otherwise(F.col("x")), F.when(F.col("x") == F.col("width") - 1, F.col("x") + r).otherwise(F.col("x")))
    ys = F.sequence(F.when(F.col("y") == 0, -t).otherwise(F.col("y")), F.when(F.col("y") == F.col("height") - 1, F.col("y") + b).otherwise(F.col("y")))
    grown = px.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))
    inside = (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y"))
    new = {c: F.when(inside, F.col(c)).otherwise(lit(v)).cast("int") for c, v in rgba.items()}
    new.update({"x": F.col("_x") + l, "y": F.col("_y") + t, "width": F.col("width") + l + r, "height": F.col("height") + t + b})
    return grown.select(*[new[c].cast("int").alias(c) if c in new else F.col(c) for c in px.columns])


CLEAR = dict.fromkeys("rgba", 0)


def icon_render(px: DataFrame, size=256) -> DataFrame:
    """Letterbox on a transparent square."""
    side, x, y, w, h = rules.icon_box(F.col("width"), F.col("height"), size)
    boxed = px.withColumns({"_side": side, "_ix": x, "_iy": y, "_iw": w, "_ih": h})
    drawn = resample(boxed, F.col("_iw"), F.col("_ih"))
    s, dx, dy = F.col("_side"), F.col("_ix"), F.col("_iy")
    # an image reduced to one pixel may be rounded past the square; the canvas cuts it off
    right, bottom = F.greatest(s - dx - F.col("width"), F.lit(0)), F.greatest(s - dy - F.col("height"), F.lit(0))
    return frame(drawn, dx, dy, right, bottom, CLEAR).drop("_side", "_ix", "_iy", "_iw", "_ih")


def margin_paint(px: DataFrame, unit="px", all=None, top=0, right=0, bottom=0, left=0, color="#000000", opacity=100) -> DataFrame:
    """Add margins; the colour covers the border only and never tints the image."""
    value = {"top": top, "right": right, "bottom": bottom, "left": left}
    t, r, b, l = (rules.margin_side(v if all is None else all, unit, F.col("width"), F.col("height")) for v in value.values())
    red, green, blue = rules.channels(color)
    alpha = F.lit(int(max(0.0, min(1.0, opacity / 100)) * 255 + 0.5))
    return frame(px, l, t, r, b, {"r": red, "g": green, "b": blue, "a": alpha})


def merge_images(
    px: DataFrame, layout: DataFrame, direction: str = "vertical", background: str | None = None, resize: str = "none"
) -> DataFrame:
    """Place the images of each album on one canvas (album, y, x); the output is ``merged.png``.

    ``layout`` comes from ``merge_layout`` and has one row per image. Each image fills its own
    stretch of the stack, so placing is a shift along it and a transparent frame across it.
    """
    places = ["draw_width", "draw_height", "place_x", "place_y", "canvas_width", "canvas_height"]
    placed = px.join(layout.select("album", "pos", "image_id", *places), "image_id")
    if resize == "fill":
        placed = resample(placed, F.col("draw_width"), F.col("draw_height"), keys=("album", "pos", "image_id"))
    px_, py_, cw, ch = (F.col(c) for c in places[2:])
    if direction == "horizontal":
        framed = frame(placed, 0, py_, 0, ch - py_ - F.col("height"), CLEAR)
        x, y = F.col("x") + px_, F.col("y")
    else:
        framed = frame(placed, px_, 0, cw - px_ - F.col("width"), 0, CLEAR)
        x, y = F.col("x"), F.col("y") + py_
    merged = framed.select(
        "album", F.lit("merged.png").alias("out_name"), y.cast("int").alias("y"), x.cast("int").alias("x"),
        "r", "g", "b", "a", cw.cast("int").alias("width"), ch.cast("int").alias("height"),
    )
    return composite_over(merged, background)
