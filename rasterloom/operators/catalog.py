"""Name, size and parameter rules on the catalogue: projections only, no shuffle unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.rounding import clamp, lit
from rasterloom.functions.scale import numbered, pos_block

def output_format(images: DataFrame) -> DataFrame:
    return images.withColumn("out_mime", rules.output_format(F.col("mime")))


def format_extension(df: DataFrame, mime: str = "mime") -> DataFrame:
    return df.withColumn("extension", rules.format_extension(F.col(mime)))


def rename_output(images: DataFrame, suffix: str, extension: str | None = None) -> DataFrame:
    """``stem-suffix.ext``; the extension follows the output format unless it is forced."""
    ext = lit(extension) if extension else rules.format_extension(rules.output_format(F.col("mime")))
    return images.withColumn("out_name", rules.rename_output(F.col("file_name"), suffix, ext))


def dedupe_names(entries: DataFrame, archive: str = "album", rows_per_block: int | None = None) -> DataFrame:
    """``unique_name`` per archive in list order; repeats get ``-2``, ``-3`` ..."""
    block = pos_block("pos", rows_per_block) if rows_per_block else pos_block("pos")
    ranked = numbered(entries, [archive, "file_name"], ["pos"], block, "_k")
    return ranked.withColumn("unique_name", rules.numbered_name(F.col("file_name"), F.col("_k"))).drop("_k")


def format_bytes(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    return df.withColumn("size_label", rules.format_bytes(F.col(size)))


def clamp_quality(df: DataFrame, quality: str = "quality") -> DataFrame:
    return df.withColumn("encoder_quality", rules.clamp_quality(F.col(quality)))


def _sized(df: DataFrame, dims: tuple[Column, Column]) -> DataFrame:
    return df.withColumns({"out_width": dims[0], "out_height": dims[1]})


def fit_max_side(images: DataFrame, max_side: int) -> DataFrame:
    return _sized(images, rules.fit_max_side(F.col("width"), F.col("height"), max_side))


def scale_dims(images: DataFrame, percent=None, fit_width=None, fit_height=None) -> DataFrame:
    if percent is not None:
        return _sized(images, rules.scale_percent(F.col("width"), F.col("height"), percent))
    return _sized(images, rules.scale_fit(F.col("width"), F.col("height"), fit_width, fit_height))


def upscale_dims(images: DataFrame) -> DataFrame:
    return _sized(images, (F.col("width") * rules.UPSCALE_FACTOR, F.col("height") * rules.UPSCALE_FACTOR))


def preview_dims(images: DataFrame, max_side: int = rules.PREVIEW_SIDE) -> DataFrame:
    return _sized(images, rules.preview_dims(F.col("width"), F.col("height"), max_side))


def crop_geometry(images: DataFrame, degrees, cx, cy, cw, ch) -> DataFrame:
    tw, th = rules.rotated_dims(F.col("width"), F.col("height"), degrees)
    x, y, w, h = rules.crop_box(tw, th, cx, cy, cw, ch)
    return images.withColumns({"crop_x": x, "crop_y": y, "crop_width": w, "crop_height": h})


def aspect_crop(images: DataFrame) -> DataFrame:
    """One row per image and aspect preset (four fixed presets), with the centred crop."""
    presets = [F.struct(F.lit(n).alias("preset"), F.lit(a).alias("rw"), F.lit(b).alias("rh"))
               for n, (a, b) in rules.ASPECT_PRESETS.items()]
    presets.append(F.struct(F.lit("original").alias("preset"), F.col("width").alias("rw"), F.col("height").alias("rh")))
    per = images.withColumn("_p", F.explode(F.array(*presets))).withColumn(
        "k", rules.aspect_factor(F.col("width"), F.col("height"), F.col("_p.rw"), F.col("_p.rh"))
    )
    x, y, w, h = rules.centred_crop(F.col("k"))
    return per.withColumns(
        {"preset": F.col("_p.preset"), "crop_x": x, "crop_y": y, "crop_width": w, "crop_height": h}
    ).drop("_p")


def icon_letterbox(images: DataFrame, size) -> DataFrame:
    side, x, y, w, h = rules.icon_box(F.col("width"), F.col("height"), size)
    return images.withColumns({"side": side, "draw_x": x, "draw_y": y, "draw_width": w, "draw_height": h})


def margin_geometry(images: DataFrame, unit: str, opacity, all=None, top=None, right=None, bottom=None, left=None) -> DataFrame:
    """Thickness of the four sides (one linked value or four), total size, output format."""
    sides = {"top": top, "right": right, "bottom": bottom, "left": left}
    px = {f"margin_{s}": rules.margin_side(v if all is None else all, unit, F.col("width"), F.col("height")) for s, v in sides.items()}
    return images.withColumns(px).withColumns(
        {
            "out_width": F.col("width") + F.col("margin_left") + F.col("margin_right"),
            "out_height": F.col("height") + F.col("margin_top") + F.col("margin_bottom"),
            "out_mime": F.when(lit(opacity) < 100, F.lit("image/png")).otherwise(
                rules.output_format(F.col("mime"))
            ),
        }
    )


def parse_hex_color(df: DataFrame, color: str = "color") -> DataFrame:
    r, g, b = rules.hex_color(F.col(color))
    return df.withColumns({"red": r, "green": g, "blue": b})


# The accepted range of each numeric setting, and the smoothness presets.
LIMITS = [
    ("adjust", "brightness", 0.0, 200.0),
    ("adjust", "contrast", 0.0, 200.0),
    ("adjust", "saturation", 0.0, 200.0),
    ("adjust", "grayscale", 0.0, 100.0),
    ("adjust", "sepia", 0.0, 100.0),
    ("adjust", "sharpen", 0.0, 100.0),
    ("adjust", "blur", 0.0, 20.0),
    ("compress", "maxSize", 320.0, None),
    ("compress", "quality", 10.0, 95.0),
    ("compress", "targetKb", 10.0, None),
    ("scale", "percent", 1.0, 200.0),
    ("scale", "fitWidth", 16.0, None),
    ("scale", "fitHeight", 16.0, None),
    ("remove-background", "tolerance", 1.0, 100.0),
    ("remove-background", "edgeSmoothing", 0.0, 100.0),
    ("margin", "all", 0.0, None),
    ("margin", "top", 0.0, None),
    ("margin", "right", 0.0, None),
    ("margin", "bottom", 0.0, None),
    ("margin", "left", 0.0, None),
    ("margin", "opacity", 0.0, 100.0),
    ("merge", "files", 2.0, None),
]
SMOOTHNESS = {"crisp": (30, 4.0), "balanced": (60, 4.0), "smooth": (100, 6.0)}
TRACE_PRESETS = ["auto", "manual"]
TRACE_MODES = ["spline", "polygon", "none"]
TRACE_HIERARCHIES = ["stacked", "cutout"]


def validate_recipes(recipes: DataFrame) -> DataFrame:
    """Adds ``failed`` (sorted names of settings out of range) and ``valid``.

    ``recipes`` is (recipe_id, tool_id, params map<string,string>). Settings left out keep
    their defaults, which are in range; a value that is no number is out of range.
    """
    def broken(tool: str, name: str, low: float, high: float | None) -> Column:
        raw = F.col("params")[name]
        number = raw.try_cast("double")
        bad = number.isNull() | (number < low)
        if high is not None:
            bad = bad | (number > high)
        return F.when((F.col("tool_id") == tool) & raw.isNotNull() & bad, F.lit(name))

    checks = [broken(*limit) for limit in LIMITS]
    checks.append(F.when((F.col("tool_id") == "ocr") & (F.col("params")["lang"] == ""), F.lit("lang")))
    failed = F.sort_array(F.array_compact(F.array(*checks)))
    return recipes.withColumn("failed", failed).withColumn("valid", F.size("failed") == 0)


def trace_params_manual(requests: DataFrame) -> DataFrame:
    """Clamp the tracing parameters, expand the smoothness preset and check the enums."""
    ints = {
        "filter_speckle": (0, 64),
        "color_precision": (1, 8),
        "layer_difference": (0, 256),
        "splice_threshold": (0, 180),
        "path_precision": (1, 10),
        "max_iterations": (1, 40),
    }
    corner = F.col("corner_threshold")
    length = F.col("length_threshold")
    if "smoothness" in requests.columns:
        for name, (c, l) in SMOOTHNESS.items():
            corner = F.when(F.col("smoothness") == name, F.lit(c)).otherwise(corner)
            length = F.when(F.col("smoothness") == name, F.lit(l)).otherwise(length)
    cols = {n: clamp(F.col(n), lo, hi).cast("int") for n, (lo, hi) in ints.items()}
    cols["corner_threshold"] = clamp(corner, 0, 180).cast("int")
    cols["length_threshold"] = clamp(length.cast("double"), 3.5, 10.0)
    cols["error"] = (
        F.when(~F.col("preset").isin(TRACE_PRESETS), F.lit("preset"))
        .when(~F.col("mode").isin(TRACE_MODES), F.lit("mode"))
        .when(~F.col("hierarchical").isin(TRACE_HIERARCHIES), F.lit("hierarchical"))
    )
    return requests.withColumns(cols)


def trace_params_auto(images: DataFrame) -> DataFrame:
    """Tracing parameters from ``flat`` and the longest side (ratio rounded half to even)."""
    longest = F.greatest("width", "height")
    flat = F.col("flat")
    wanted = F.bround(F.lit(1000.0) / longest, 0)
    factor = F.when(flat & (longest < 600), clamp(wanted, 1.0, 4.0)).otherwise(F.lit(1.0)).cast("int")
    return images.withColumn("factor", factor).withColumns(
        {
            "filter_speckle": F.when(flat, F.least(F.lit(64), F.col("factor") * 8)).otherwise(F.lit(10)),
            "color_precision": F.lit(6),
            "layer_difference": F.when(flat, F.lit(16)).otherwise(F.lit(28)),
            "corner_threshold": F.lit(60),
            "length_threshold": F.lit(4.0),
            "splice_threshold": F.lit(45),
            "path_precision": F.when(F.col("factor") > 1, F.lit(2)).otherwise(F.lit(3)),
            "max_iterations": F.lit(10),
        }
    )


def ocr_lang_check(requests: DataFrame, lang: str = "lang") -> DataFrame:
    return requests.withColumn("lang_ok", F.coalesce(F.col(lang).rlike(rules.LANGUAGE_PATTERN), F.lit(False)))
