"""Plans over whole collections: renditions, chaining, layouts, budgets, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.rounding import half_up
from rasterloom.functions.scale import BLOCK_ROWS, BROADCAST_ROWS, dimension_join, pos_block, running
from rasterloom.operators import runner
from rasterloom.operators import tools as T
from rasterloom.operators.catalog import validate_recipes
from rasterloom.operators.intake import REJECT_MESSAGES, intake_guard, reject_reason

# ---- renditions -------------------------------------------------------------------------


PLAN_COLUMNS = (
    "grain string, image_id bigint, album string, pos int, recipe_id string, tool_id string, out_width bigint, out_height bigint, "
    "out_mime string, out_name string, knob string, setting double, fits boolean, reason string, failed string"
)
MERGED_NAME = "merged.png"


def column_names() -> list[str]:
    return [f.split(" ")[0] for f in PLAN_COLUMNS.split(", ")]


def rendition_plan(
    images: DataFrame, recipes: DataFrame, rungs: DataFrame | None = None, max_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """What every recipe makes of every image or album: rows of three grains in one table.

    * ``image``: an accepted image and a per-image recipe. Compression to a target size has its ``knob`` and
      ``setting`` from the measured ``rungs`` (image_id, k, size_bytes; see :func:`target_settings`); a PNG shrinks by it.
    * ``album``: the accepted images of an album and a merge recipe.
    * ``recipe``: a recipe whose settings are out of range, or whose tool is unknown, once, with what ``failed``.

    Work that cannot be done stays in the plan with its ``reason`` and no output size. ``images`` has ``size_bytes``
    besides the catalogue's columns; ``recipes`` is (recipe_id, tool_id, params). The theta condition "the tool accepts the
    type" becomes an equi-join by listing each recipe under the types its tool accepts.
    """
    dim = F.broadcast(T.tools(images.sparkSession).select("tool_id", "accepted_types", "suffix", "out_ext"))
    judged = validate_recipes(recipes).join(dim, "tool_id", "left")
    usable = judged.filter(F.col("valid") & F.col("suffix").isNotNull())
    parts = [
        _image_rows(images, usable.filter("tool_id <> 'merge'"), rungs, max_broadcast),
        _album_rows(images, usable.filter("tool_id = 'merge'"), max_broadcast),
        _recipe_rows(judged),
    ]
    return reduce(DataFrame.unionByName, [_plan_columns(part) for part in parts])


def _plan_columns(part: DataFrame) -> DataFrame:
    """The plan's columns in order; those a grain does not have are null."""
    fields = [f.split(" ") for f in PLAN_COLUMNS.split(", ")]
    return part.select(*[(F.col(n) if n in part.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _image_rows(images: DataFrame, usable: DataFrame, rungs: DataFrame | None, max_broadcast: int) -> DataFrame:
    listed = usable.withColumn("mime", F.explode("accepted_types")).select("recipe_id", "tool_id", "params", "mime", "suffix", "out_ext")
    planned = dimension_join(images, listed, ["mime"], F.col("image_id"), max_broadcast)
    planned = planned.withColumn("reason", refusal(F.col("tool_id")))
    asked = (F.col("tool_id") == "compress") & (_param("mode", "quality", "string") == "target")
    budget = F.when(asked, (_param("targetKb", 500.0, "double") * 1024).cast("bigint"))
    planned = planned.select("image_id", "album", "pos", "recipe_id", "tool_id", "reason", budget.alias("budget"), *_rendition_columns())
    if rungs is None:
        found = planned.withColumns({"bit": F.lit(None).cast("int"), "met": F.lit(None).cast("boolean")})
    else:
        wanted = planned.filter(F.col("budget").isNotNull()).select("image_id", "recipe_id", "budget")
        found = planned.join(target_settings(wanted, rungs), ["image_id", "recipe_id"], "left")
    targeted = F.col("budget").isNotNull()
    png = F.col("out_mime") == "image/png"
    searched = search_setting(F.col("bit"), png)
    reason = F.coalesce("reason", F.when(targeted & F.col("bit").isNull(), F.lit("not_measured")))
    done = reason.isNull()
    side = lambda c: F.when(targeted & png, rules.at_least_one(F.col(c) * searched)).otherwise(F.col(c))
    return found.select(
        F.lit("image").alias("grain"), "image_id", "album", "pos", "recipe_id", "tool_id", reason.alias("reason"), "out_mime", "out_name",
        *[F.when(done, side(c)).alias(c) for c in ("out_width", "out_height")],
        F.when(done, F.when(targeted & png, F.lit("scale")).when(targeted, F.lit("quality")).when(F.col("tool_id") == "compress", F.lit("quality"))).alias("knob"),
        F.when(done, F.when(targeted, searched).when(F.col("tool_id") == "compress", F.col("encoder_quality"))).alias("setting"),
        F.when(done, F.col("met")).alias("fits"),
    )


def _album_rows(images: DataFrame, merges: DataFrame, max_broadcast: int) -> DataFrame:
    """One row per album with an accepted image and merge recipe; canvas sizes are sums and maxima per album."""
    members = images.filter(F.col("mime").isin(*T.ACCEPTED_TYPES)).select("album", "width", "height")
    stats = members.groupBy("album").agg(
        F.count(F.lit(1)).alias("files"), *[F.max(c).cast("bigint").alias(f"max_{c}") for c in ("width", "height")],
        *[F.sum(c).cast("bigint").alias(f"sum_{c}") for c in ("width", "height")])
    # Scaled to the longest side across the stack, for both directions at once.
    drawn = lambda main, cross: rules.at_least_one(F.col(main) * F.when(
        F.col(cross) > 0, F.col(f"max_{cross}").cast("double") / F.col(cross)).otherwise(F.lit(1.0)))
    filled = members.join(stats.select("album", "max_width", "max_height"), "album").groupBy("album").agg(
        F.sum(drawn("width", "height")).alias("fill_width"), F.sum(drawn("height", "width")).alias("fill_height"))
    albums = stats.join(filled, "album").withColumn("tool_id", F.lit("merge"))
    planned = dimension_join(albums, merges.select("recipe_id", "tool_id", "params"), ["tool_id"], F.col("album"), max_broadcast)
    across = _param("direction", "vertical", "string") == "horizontal"
    fill = _param("resize", "none", "string") == "fill"
    size = lambda c, along: F.when(along, F.when(fill, F.col(f"fill_{c}")).otherwise(F.col(f"sum_{c}"))).otherwise(F.col(f"max_{c}"))
    reason = F.when(F.col("files") < 2, F.lit("too_few_files"))
    return planned.select(
        F.lit("album").alias("grain"), "album", "recipe_id", "tool_id", reason.alias("reason"),
        F.when(reason.isNull(), size("width", across)).alias("out_width"), F.when(reason.isNull(), size("height", ~across)).alias("out_height"),
        F.lit("image/png").alias("out_mime"), F.lit(MERGED_NAME).alias("out_name"))


def _recipe_rows(judged: DataFrame) -> DataFrame:
    unknown = F.col("suffix").isNull()
    return judged.filter(unknown | ~F.col("valid")).select(
        F.lit("recipe").alias("grain"), "recipe_id", "tool_id", F.when(unknown, F.lit("unknown_tool")).otherwise(F.lit("invalid_settings")).alias("reason"),
        F.when(~unknown, F.array_join("failed", ",")).alias("failed"))


# ---- target sizes -----------------------------------------------------------------------

# Steps of the search and its range; the upper end for PNG, where the sides shrink, is 1.
SEARCH_STEPS, LOW, HIGH, HIGH_SCALE = 7, 0.05, 0.95, 1.0


def target_settings(wanted: DataFrame, rungs: DataFrame, steps: int = SEARCH_STEPS) -> DataFrame:
    """(image_id, recipe_id, bit, met) for ``wanted`` (image_id, recipe_id, budget): the rung the search ends at.

    A rung only matters by whether it fits, so a ladder becomes one bit per rung (OR is combined before the shuffle) and
    the bisection reads its bits: exact for any sizes, growing with k or not. Rung 0 is left where nothing
    fits; ``met`` tells whether the size found is within the budget. ``rungs`` may have a recipe_id of its own.
    """
    on = [c for c in ("image_id", "recipe_id") if c in rungs.columns]
    words = max(1, (1 << steps) // 64)
    fits = (F.col("size_bytes") <= F.col("budget")) & F.col("k").between(0, (1 << steps) - 1)
    bits = [
        F.bit_or(F.when(fits & (F.floor(F.col("k") / 64) == w), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("k") % 64).cast("int")))
                 .otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(words)]
    ladders = wanted.join(rungs, on).groupBy("image_id", "recipe_id").agg(*bits)
    taken = lambda k: F.call_function(
        "shiftright", F.when(k < 64, F.col("w0")).otherwise(F.col("w1")) if words == 2 else F.col("w0"), (k % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    start = F.struct(F.lit(0).alias("low"), F.lit(1 << steps).alias("high"))

    def step(state: Column, _i: Column) -> Column:
        mid = F.shiftright(state["low"] + state["high"], 1)
        fit = taken(mid)
        return F.struct(F.when(fit, mid).otherwise(state["low"]).alias("low"), F.when(fit, state["high"]).otherwise(mid).alias("high"))

    ended = ladders.withColumn("bit", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["low"])
    return ended.select("image_id", "recipe_id", "bit", taken(F.col("bit")).alias("met"))


def search_setting(k: Column, shrinks: Column, steps: int = SEARCH_STEPS) -> Column:
    """Quality (or scale, where the format has none) at rung ``k``."""
    top = F.when(shrinks, F.lit(HIGH_SCALE)).otherwise(F.lit(HIGH))
    return F.lit(LOW) + (top - F.lit(LOW)) * k / F.lit(float(1 << steps))


# ---- one image --------------------------------------------------------------------------

# The tools that a service runs, with its limits on files.
SERVICE_TOOLS = ("convert-svg", "upscale", "ocr")


def refusal(tool: Column) -> Column:
    """Why a tool refuses an image of an accepted type, null if it does not."""
    file = F.when(tool.isin(*SERVICE_TOOLS), reject_reason(F.col("mime"), F.col("size_bytes")))
    long = F.greatest("width", "height") > rules.MAX_UPSCALE_SIDE
    return F.coalesce(file, F.when((tool == "upscale") & long, F.lit("side_too_long")))


def _param(name: str, default, kind: str) -> Column:
    return F.coalesce(F.col("params")[name].try_cast(kind), F.lit(default).cast(kind))


def _rendition_columns() -> list[Column]:
    tool = F.col("tool_id")
    keep = rules.output_format(F.col("mime"))
    wanted = _param("format", "image/webp", "string")
    is_icon = (tool == "convert") & (wanted == "image/x-icon")
    opacity = _param("opacity", 100.0, "double")
    fmt = (
        F.when(tool == "convert", wanted)
        .when(tool == "convert-svg", F.lit("image/svg+xml"))
        .when(tool == "ocr", F.lit("text/plain"))
        .when(tool.isin("remove-background", "upscale"), F.lit("image/png"))
        .when((tool == "margin") & (opacity < 100), F.lit("image/png"))
        .otherwise(keep)
    )
    ext = F.coalesce(F.col("out_ext"), rules.format_extension(fmt))
    suffix = F.when(is_icon, F.lit("icon")).otherwise(F.col("suffix"))
    name = F.when(tool == "ocr", F.concat(rules.stem(F.col("file_name")), F.lit(".txt"))).otherwise(
        rules.rename_output(F.col("file_name"), suffix, ext)
    )

    percent_w, percent_h = rules.scale_percent(F.col("width"), F.col("height"), _param("percent", 50.0, "double"))
    fit_w, fit_h = rules.scale_fit(
        F.col("width"), F.col("height"), _param("fitWidth", 1920.0, "double"), _param("fitHeight", 1080.0, "double")
    )
    by_fit = _param("mode", "percent", "string") == "fit"
    max_w, max_h = rules.fit_max_side(F.col("width"), F.col("height"), _param("maxSize", 1600, "int"))
    side, *_ = rules.icon_box(F.col("width"), F.col("height"), _param("size", 256.0, "double"))
    rot_w, rot_h = rules.rotated_dims(F.col("width"), F.col("height"), _param("rotate", 0, "int"))
    # A side of the edited image that the recipe leaves open is the crop's own.
    box = rules.crop_box(rot_w, rot_h, *[_param(f"crop{c}", d, "double") for c, d in (("X", 0.0), ("Y", 0.0), ("Width", 1.0), ("Height", 1.0))])
    asked = lambda name: F.col("params")[name].try_cast("double")
    given = lambda name, own: F.when(asked(name).isNotNull(), rules.at_least_one(asked(name))).otherwise(own)
    edit_w, edit_h = given("width", box[2].cast("bigint")), given("height", box[3].cast("bigint"))
    unit_pc = _param("unit", "px", "string") == "percent"
    linked = _param("linked", True, "boolean")

    def side_px(name: str) -> Column:
        v = F.when(linked, _param("all", 40.0, "double")).otherwise(_param(name, 40.0, "double"))
        return F.when(unit_pc, rules.margin_side(v, "percent", F.col("width"), F.col("height"))).otherwise(
            rules.margin_side(v, "px", F.col("width"), F.col("height"))
        )

    one = F.lit(1).cast("bigint")

    def dims(w: Column, h: Column, pick: int) -> Column:
        wh = lambda a, b: (a, b)[pick].cast("bigint")
        return (
            F.when((tool == "scale") & by_fit, wh(fit_w, fit_h))
            .when(tool == "scale", wh(percent_w, percent_h))
            .when(tool == "compress", F.greatest(one, wh(max_w, max_h)))
            .when(is_icon, side)
            .when(tool == "upscale", wh(F.col("width"), F.col("height")) * rules.UPSCALE_FACTOR)
            .when(tool == "resize", wh(edit_w, edit_h))
            .when(
                tool == "margin",
                wh(F.col("width") + side_px("left") + side_px("right"), F.col("height") + side_px("top") + side_px("bottom")),
            )
            .otherwise(wh(F.col("width"), F.col("height")))
        )

    return [
        dims(F.col("width"), F.col("height"), 0).alias("out_width"),
        dims(F.col("width"), F.col("height"), 1).alias("out_height"),
        fmt.alias("out_mime"),
        name.alias("out_name"),
        rules.clamp_quality(_param("quality", 75.0, "double")).alias("encoder_quality"),
    ]


def compress_plan(images: DataFrame, max_side: int, quality: float) -> DataFrame:
    """Fixed-quality compression: bounded size, encoder quality, format and name."""
    w, h = rules.fit_max_side(F.col("width"), F.col("height"), max_side)
    fmt = rules.output_format(F.col("mime"))
    return images.withColumns(
        {
            "out_width": w,
            "out_height": h,
            "encoder_quality": rules.clamp_quality(quality),
            "out_mime": fmt,
            "out_name": rules.rename_output(F.col("file_name"), "compressed", rules.format_extension(fmt)),
        }
    )


def plan_key(content_crc: Column, params: Column) -> Column:
    """Hash of what a result depends on: the file's content and the recipe's settings."""
    entries = F.transform(
        F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.sha2(F.concat_ws("|", content_crc.cast("string"), F.array_join(entries, "&")), 256)


def incremental_plan(plan: DataFrame, finished: DataFrame) -> DataFrame:
    """Planned work whose (image, recipe, input-and-settings key) is not finished yet."""
    return plan.join(finished.select("image_id", "recipe_id", "work_key"), ["image_id", "recipe_id", "work_key"], "left_anti")


# ---- chaining ---------------------------------------------------------------------------


def chain_targets_album(outputs: DataFrame, current_tool: str) -> DataFrame:
    """Batch tools (not the current one) that accept every type of an album's outputs."""
    spark = outputs.sparkSession
    types = outputs.select("album", "mime").distinct()
    wanted = types.groupBy("album").agg(F.count(F.lit(1)).alias("n_types"))
    offer = T.accepts(spark).filter(F.col("batch") & (F.col("tool_id") != current_tool))
    covered = (
        types.join(F.broadcast(offer), "mime")
        .groupBy("album", "tool_id")
        .agg(F.count(F.lit(1)).alias("n_covered"))
    )
    return covered.join(wanted, "album").filter("n_covered = n_types").select("album", "tool_id")


def chain_targets_single(outputs: DataFrame, current_tool: str) -> DataFrame:
    offer = T.accepts(outputs.sparkSession).filter(F.col("tool_id") != current_tool)
    return outputs.join(F.broadcast(offer.select("tool_id", "mime")), "mime").select("image_id", "tool_id")


# ---- aggregations and reports -----------------------------------------------------------


def album_totals(outputs: DataFrame, prefix: str = "album") -> DataFrame:
    return (
        outputs.groupBy("album")
        .agg(F.count(F.lit(1)).alias("n_outputs"), F.sum("size_bytes").alias("total_bytes"))
        .withColumn(
            "archive_name", F.concat(F.lit(f"{prefix}-"), F.col("n_outputs").cast("string"), F.lit("-images.zip"))
        )
        .withColumn("total_label", rules.format_bytes(F.col("total_bytes")))
    )


def distinct_types(outputs: DataFrame) -> DataFrame:
    return outputs.select("album", "mime").distinct()


def preview_top4(outputs: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("album").orderBy("pos"))
    return outputs.withColumn("preview_pos", rank).filter("preview_pos <= 4")


def batch_run(
    images: DataFrame, tool_id: str | None = None, kernel=None, output: str = "", fallback: str = "The image could not be processed.",
    reads: tuple[str, ...] = ("content",), drops: tuple[str, ...] = ("content",),
) -> DataFrame:
    """Every file is attempted; ``ok`` and ``message`` tell how it went, in list order (``pos``).

    Guards come first; with a tool, what that tool refuses fails too. With a file ``kernel`` (a loader, see
    :func:`rasterloom.operators.runner.attempt`) the tool itself then works on each file that is left: its columns ``output`` join
    the row, and what it raises fails that file only.
    """
    guarded = intake_guard(images)
    if tool_id is not None:
        guarded = guarded.withColumn("reason", F.coalesce("reason", refusal(F.lit(tool_id))))
    message = F.lit(None).cast("string")
    for reason, text in REJECT_MESSAGES.items():
        message = F.when(F.col("reason") == reason, F.lit(text)).otherwise(message)
    if kernel is None:
        return guarded.withColumn("ok", F.col("reason").isNull()).withColumn("message", message)
    return runner.attempt(guarded.withColumn("_refused", message), kernel, output, fallback, list(reads), drops, "_refused").drop("_refused")


def renditions(run: DataFrame) -> DataFrame:
    return run.filter("ok")


def failures(run: DataFrame) -> DataFrame:
    return run.filter("not ok").select("album", "pos", "file_name", "message")


def batch_report(run: DataFrame) -> DataFrame:
    """One line per album: which files failed and why (empty when none did).

    Counts are plain aggregates; the first three failures are a ranked filter that Spark
    applies before the shuffle too, so a hot album never gathers its whole failure list.
    """
    totals = run.groupBy("album").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("ok"), 1)).alias("failed")
    )
    rank = F.row_number().over(Window.partitionBy("album").orderBy("pos"))
    first = (
        failures(run)
        .withColumn("rn", rank)
        .filter("rn <= 3")
        .groupBy("album")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "file_name", "message"))).alias("first"))
    )
    names = F.array_join(F.transform("first", lambda f: f["file_name"]), ", ")
    why = F.col("first")[0]["message"]
    more = F.when(
        F.col("failed") > 3, F.concat(F.lit(" and "), (F.col("failed") - 3).cast("string"), F.lit(" more"))
    ).otherwise(F.lit(""))
    report = (
        F.when(F.col("failed") == 0, F.lit(""))
        .when(F.col("total") == 1, why)
        .otherwise(
            F.concat(
                F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"),
                F.lit(" images failed ("), names, more, F.lit("): "), why,
            )
        )
    )
    return totals.join(first, "album", "left").select("album", "total", "failed", report.alias("report"))


# ---- layouts, budgets, archives ---------------------------------------------------------


def merge_layout(
    members: DataFrame, direction: str = "vertical", alignment: str = "start", resize: str = "none",
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Placement of every image of an album on the common canvas, in list order.

    The canvas size is one aggregate with map-side combine (two where the images are scaled);
    only the running offset along the stack needs the order, and it is summed block by block.
    """
    horizontal = direction == "horizontal"
    cross, main = ("height", "width") if horizontal else ("width", "height")
    stats = members.groupBy("album").agg(F.max(cross).alias("_target"), F.sum(main).alias("_main"))
    sized = members.join(stats, "album")
    if resize == "fill":
        scale = F.when(F.col(cross) > 0, F.col("_target").cast("double") / F.col(cross)).otherwise(F.lit(1.0))
        sized = sized.withColumns({f"draw_{s}": rules.at_least_one(F.col(s) * scale) for s in ("width", "height")})
        scaled = sized.groupBy("album").agg(F.sum(f"draw_{main}").alias("_main"))
        sized = sized.drop("_main").join(scaled, "album")
    else:
        sized = sized.withColumns({f"draw_{s}": F.col(s).cast("bigint") for s in ("width", "height")})
    free = F.col("_target") - F.col(f"draw_{cross}")
    offset = {"start": F.lit(0).cast("bigint"), "center": half_up(free / F.lit(2.0)), "end": free}[alignment]
    placed = running(
        sized, ["album"], ["pos"], pos_block("pos", rows_per_block), F.col(f"draw_{main}"), "_cursor"
    )
    along, across = ("x", "y") if horizontal else ("y", "x")
    return placed.withColumns(
        {
            f"place_{along}": F.col("_cursor"),
            f"place_{across}": offset.cast("bigint"),
            f"canvas_{main}": F.col("_main"),
            f"canvas_{cross}": F.col("_target").cast("bigint"),
        }
    ).drop("_target", "_cursor", "_main")


def budget_search(images: DataFrame, rungs: DataFrame, target: Column, steps: int = 7) -> DataFrame:
    """Replay the bisection over measured rungs: exact for any sizes, monotone or not.

    ``rungs`` is (image_id, k, size_bytes) with k = 0..127. Each image's ladder is one short
    array (128 entries at most), folded inside the JVM. k = 0 is the fallback when nothing
    fits. Rung k stands for low + k/128 of the searched range.
    """
    ladder = rungs.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "size_bytes"))).alias("_sizes")
    )
    start = F.struct(F.lit(0).alias("low"), F.lit(1 << steps).alias("high"), F.lit(0).alias("best"))

    def step(state: Column, _i: Column) -> Column:
        mid = F.shiftright(state["low"] + state["high"], 1)
        fits = F.element_at("_sizes", mid) <= F.col("_budget")
        return F.struct(
            F.when(fits, mid).otherwise(state["low"]).alias("low"),
            F.when(fits, state["high"]).otherwise(mid).alias("high"),
            F.when(fits, mid).otherwise(state["best"]).alias("best"),
        )

    is_png = rules.output_format(F.col("mime")) == "image/png"
    return (
        images.join(ladder, "image_id", "left")
        .withColumn("_budget", target)
        # An image without a ladder stays, with nothing found.
        .withColumn("k", F.when(F.col("_sizes").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["best"]))
        .withColumn("size_at_k", F.element_at("_sizes", F.col("k")))
        .withColumn("setting", search_setting(F.col("k"), is_png, steps))
        .withColumn("knob", F.when(is_png, F.lit("scale")).otherwise(F.lit("quality")))
        .withColumn("fits", F.col("size_at_k") <= F.col("_budget"))
        .drop("_sizes", "_budget")
    )


def budget_search_monotone(images: DataFrame, rungs: DataFrame, target: Column, steps: int = 7) -> DataFrame:
    """The same answer where size never falls with k: one aggregate, no ladder arrays.

    Budgets, a row per image, are the side held in memory; rungs stream past them and are not sorted.
    """
    budget = images.select("image_id", target.alias("_budget")).hint("shuffle_hash")
    best = (
        rungs.join(budget, "image_id")
        .groupBy("image_id")
        .agg(
            F.coalesce(
                F.max(F.when((F.col("size_bytes") <= F.col("_budget")) & (F.col("k") >= 1), F.col("k"))), F.lit(0)
            ).alias("k")
        )
    )
    return images.join(best, "image_id", "left")


def measured(files: DataFrame) -> DataFrame:
    """``crc`` and ``entry_bytes`` in place of ``content``: taken at the scan, so that contents travel no further."""
    return files.withColumns({"crc": F.crc32("content"), "entry_bytes": F.octet_length("content")}).drop("content")


def archive_entries(entries: DataFrame, archive: str = "album", rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """Archive table of contents: CRC-32, size and local header offset per entry, in order.

    ``entries`` has ``unique_name``, ``pos`` and ``content``, or its measures (:func:`measured`). The offset is the running
    sum of ``30 + name bytes + content bytes`` of the entries before.
    """
    sized = (measured(entries) if "content" in entries.columns else entries).withColumn("name_bytes", F.octet_length("unique_name"))
    step = F.lit(30).cast("bigint") + F.col("name_bytes") + F.col("entry_bytes")
    return running(sized, [archive], ["pos"], pos_block("pos", rows_per_block), step, "header_offset")


def archive_totals(contents: DataFrame, archives: DataFrame, archive: str = "album") -> DataFrame:
    """Directory offset, directory size and file size per archive; an empty one has 22 bytes."""
    sums = contents.groupBy(archive).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum(F.lit(30).cast("bigint") + F.col("name_bytes") + F.col("entry_bytes")).alias("directory_offset"),
        F.sum(F.lit(46).cast("bigint") + F.col("name_bytes")).alias("directory_bytes"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return archives.select(archive).distinct().join(sums, archive, "left").select(
        archive,
        zero("n_entries").alias("n_entries"),
        zero("directory_offset").alias("directory_offset"),
        zero("directory_bytes").alias("directory_bytes"),
        (zero("directory_offset") + zero("directory_bytes") + 22).alias("archive_bytes"),
    )
