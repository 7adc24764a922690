"""Flat-art test, palettes, colour runs, connected regions and SVG output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scale import cut, stored
from rasterloom.operators import catalog, pixels_geometry, pixels_neighborhood
from rasterloom.operators import labelling as L
from rasterloom.operators.pixels_point import alpha_extrema, color_histogram

# Fixed values of the flat-art test and of the palette.
THUMB_SIDE, MAX_COLORS, TOP_COLORS, FLAT_COVERAGE = 128, 4096, 12, 0.85
PALETTE_ROUNDS = 4
PALETTE_SALTS = 8
# Colours of an image up to which its palette is cut in windows.
WINDOW_COLORS = 1 << 18


def flat_art_flag(px: DataFrame, max_side: int = THUMB_SIDE) -> DataFrame:
    """Flat art when the twelve most common colours cover 85 % of the thumbnail.

    The thumbnail bounds the ranked histogram to 128 x 128 colours per image.
    """
    opaque = px.withColumn("a", F.lit(255))
    histogram = color_histogram(pixels_geometry.thumbnail(opaque, max_side))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n")))
    stats = histogram.withColumn("rank", rank).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_colors"), F.sum("n").alias("total"),
        F.sum(F.when(F.col("rank") <= TOP_COLORS, F.col("n")).otherwise(0)).alias("top"),
    )
    flat = (F.col("n_colors") <= MAX_COLORS) & (F.col("top") / F.col("total") >= FLAT_COVERAGE)
    return stats.select("image_id", "n_colors", flat.alias("flat"))


def median_cut(histogram: DataFrame, rounds: int = PALETTE_ROUNDS, window_colors: int = WINDOW_COLORS) -> DataFrame:
    """Histogram rows with the palette ``box`` they fall in (2^rounds boxes at most).

    Each round splits every box of two or more colours at half its weight along its longest
    channel. Images of up to ``window_colors`` colours are partitioned by image once, and all rounds run inside that
    partitioning; those with more are split on marginal sums instead, with the same result and no image in one task.
    """
    histogram = stored(histogram.select("image_id", "r", "g", "b", "n"), "histogram")
    large = stored(histogram.groupBy("image_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > window_colors).select("image_id"), "many-colors")
    if large.isEmpty():
        return _cut_in_windows(histogram, rounds)
    usual = _cut_in_windows(histogram.join(large, "image_id", "left_anti"), rounds)
    return usual.unionByName(_cut_on_marginals(histogram.join(large, "image_id", "left_semi"), rounds))


def _cut_in_windows(histogram: DataFrame, rounds: int) -> DataFrame:
    h = histogram.repartition("image_id").withColumn("box", F.lit(0))
    for _ in range(rounds):
        whole = Window.partitionBy("image_id", "box")
        spread = {f"_s{c}": F.max(c).over(whole) - F.min(c).over(whole) for c in "rgb"}
        h = h.withColumns({**spread, "_total": F.sum("n").over(whole), "_colors": F.count(F.lit(1)).over(whole)})
        longest = (
            F.when((F.col("_sr") >= F.col("_sg")) & (F.col("_sr") >= F.col("_sb")), F.col("r"))
            .when(F.col("_sg") >= F.col("_sb"), F.col("g")).otherwise(F.col("b"))
        )
        h = h.withColumn("_along", longest)
        order = whole.orderBy("_along", "r", "g", "b")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nth = F.row_number().over(order)
        h = h.withColumns({"_before": before, "_nth": nth})
        upper = (F.col("_colors") > 1) & (
            (F.col("_before") * 2 >= F.col("_total")) | (F.col("_nth") == F.col("_colors"))
        )
        h = h.withColumn("box", F.col("box") * 2 + F.when(upper, 1).otherwise(0)).drop(
            "_sr", "_sg", "_sb", "_total", "_colors", "_along", "_before", "_nth"
        )
    return h


def _cut_on_marginals(histogram: DataFrame, rounds: int) -> DataFrame:
    """The same splits from sums per channel value: at most 256 rows per box and step, whatever the number of colours.

    Colours are ordered by the longest channel, then by the other two. The value of the first channel at which the box reaches half its
    weight is found on its sums, and only the colours of that value are summed by the second channel, then by the third.
    """
    key = ["image_id", "box"]
    h = histogram.withColumn("box", F.lit(0))
    for _ in range(rounds):
        h = stored(h, "boxes")
        spread = lambda c: F.max(c) - F.min(c)
        sizes = h.groupBy(*key).agg(*[spread(c).alias(f"s{c}") for c in "rgb"], F.sum("n").alias("total"), F.count(F.lit(1)).alias("colors"))
        axis = F.when((F.col("sr") >= F.col("sg")) & (F.col("sr") >= F.col("sb")), 0).when(F.col("sg") >= F.col("sb"), 1).otherwise(2)
        sizes = stored(sizes.filter("colors > 1").select(*key, axis.alias("axis"), "total"), "box-sizes")
        at = {"c1": F.when(F.col("axis") == 0, F.col("r")).when(F.col("axis") == 1, F.col("g")).otherwise(F.col("b")),
              "c2": F.when(F.col("axis") == 0, F.col("g")).otherwise(F.col("r")), "c3": F.when(F.col("axis") == 2, F.col("g")).otherwise(F.col("b"))}
        t = h.join(sizes, key).select(*key, *[v.alias(c) for c, v in at.items()], "n", "total")
        last = t.groupBy(*key).agg(F.max(F.struct(*at)).alias("last"))
        found, base, fixed = None, F.lit(0).cast("bigint"), []
        for c in at:
            rows = t if found is None else t.join(found, [*key, *fixed])
            sums = rows.groupBy(*key, c, *fixed).agg(F.sum("n").alias("n"), F.first("total").alias("total"), *([F.first("base").alias("base")] if fixed else []))
            up_to = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            below = sums.withColumn("base", up_to + (F.col("base") if fixed else base)).filter(F.col("base") * 2 < F.col("total"))
            found = below.groupBy(*key).agg(F.max_by(F.struct(*fixed, c, "base"), c).alias("f")).select(*key, "f.*")
            fixed = [*fixed, c]
        cuts = stored(found.join(last, key).select(*key, F.struct(*at).alias("cut"), "last"), "cuts").join(sizes.select(*key, "axis"), key)
        mine = F.struct(*[v.alias(c) for c, v in at.items()])
        upper = (mine > F.col("cut")) | ((F.col("cut") == F.col("last")) & (mine == F.col("last")))
        h = h.join(cuts, key, "left").withColumn("box", F.col("box") * 2 + F.when(upper, 1).otherwise(0)).drop("axis", "cut", "last")
    return h


def palette(boxes: DataFrame) -> DataFrame:
    mean = lambda c: F.bround(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 0).cast("int")
    return boxes.groupBy("image_id", "box").agg(
        F.sum("n").alias("weight"), mean("r").alias("pr"), mean("g").alias("pg"), mean("b").alias("pb")
    )


def quantize(px: DataFrame, rounds: int = PALETTE_ROUNDS, window_colors: int = WINDOW_COLORS) -> DataFrame:
    """Every pixel takes its palette colour. A common colour is spread over several salts."""
    boxes = stored(median_cut(color_histogram(px), rounds, window_colors), "colors")
    mapping = boxes.join(palette(boxes).drop("weight"), ["image_id", "box"]).select("image_id", "r", "g", "b", "pr", "pg", "pb")
    salted = mapping.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PALETTE_SALTS - 1))))
    spread = px.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(PALETTE_SALTS)).cast("int"))
    new = {"r": F.col("pr"), "g": F.col("pg"), "b": F.col("pb")}
    joined = spread.join(salted, ["image_id", "r", "g", "b", "_salt"])
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in px.columns])


def trace_flags(px: DataFrame) -> DataFrame:
    """Per image: size, flat, has_alpha and the automatic tracing parameters."""
    sizes = px.filter("x = 0 and y = 0").select("image_id", "width", "height")
    flags = sizes.join(flat_art_flag(px), "image_id").join(alpha_extrema(px), "image_id")
    return catalog.trace_params_auto(flags)


def trace_prepare(px: DataFrame) -> DataFrame:
    """Pixels ready for tracing, by kind of image.

    Flat and opaque: enlarge, majority filter, 16-colour palette. Flat with alpha: enlarge.
    Photo: median filter. Enlarged images keep their former size in ``orig_width/height``.
    """
    flags = stored(trace_flags(px).select("image_id", "flat", "has_alpha", "factor"), "flags")
    tagged = px.join(flags, "image_id").withColumns({"orig_width": F.col("width"), "orig_height": F.col("height")})
    out = [c for c in px.columns] + ["orig_width", "orig_height"]
    flat = pixels_geometry.resample_lanczos(tagged.filter("flat"), F.col("factor"))
    # the palette reads its input twice (colours, then pixels), so the filtered pixels are written once
    opaque = quantize(stored(pixels_neighborhood.mode5(flat.filter("not has_alpha")), "majority"))
    photo = pixels_neighborhood.median3(tagged.filter("not flat").withColumn("a", F.lit(255)))
    return opaque.select(out).unionByName(flat.filter("has_alpha").select(out)).unionByName(photo.select(out))


# ---- runs and regions -------------------------------------------------------------------


def _color() -> Column:
    channels = [F.shiftleft(F.col(c).cast("bigint"), s) for c, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))]
    return channels[0].bitwiseOR(channels[1]).bitwiseOR(channels[2]).bitwiseOR(channels[3])


def with_runs(px: DataFrame) -> DataFrame:
    """Pixels with the start ``x0`` of the equal-colour run of their scan line."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    p = px.withColumn("_color", _color())
    starts = F.lag("_color").over(row)
    p = p.withColumn("_start", F.when(starts.isNull() | (starts != F.col("_color")), F.col("x")))
    return p.withColumn("x0", F.max("_start").over(row.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def color_runs(px: DataFrame) -> DataFrame:
    """One row per run: image_id, y, x0, x1 and its colour (no shuffle beyond the rows')."""
    return with_runs(px).groupBy("image_id", "y", "x0").agg(
        F.max("x").alias("x1"), *[F.first(c).alias(c) for c in "rgba"]
    )


def _lookup(left: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent where it has one (many rows may share a parent)."""
    p = parents.select("image_id", F.col("node").alias(column), F.col("parent").alias("_p"))
    return left.join(p, ["image_id", column], "left").withColumn(column, F.coalesce("_p", column)).drop("_p")


def components(edges: DataFrame) -> DataFrame:
    """(image_id, node, label): the smallest node connected to each node that has an edge.

    Rounds of contraction: every node takes the smallest of its neighbours (an aggregate with
    map-side combine), parents are followed twice, and the edges are rewritten to the parents
    with loops and repeats removed. The edges shrink by a large factor each round, so the number
    of rounds is logarithmic; each round is checkpointed. Common parents make skewed joins only
    on the side that adaptive execution can split.
    """
    edges = cut(edges.select("image_id", "u", "v"))
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy("image_id", F.col("u").alias("node")).agg(F.min("v").alias("_v")).select(
            "image_id", "node", F.least("node", "_v").alias("parent")
        )
        for _ in range(2):
            parents = _lookup(parents, "parent", parents)
        parents = cut(parents)
        steps.append(parents)
        moved = _lookup(_lookup(edges, "u", parents), "v", parents)
        edges = cut(moved.filter("u <> v").distinct())
    if not steps:
        return edges.select("image_id", F.col("u").alias("node"), F.col("v").alias("label"))
    labels = steps[-1]
    for parents in reversed(steps[:-1]):
        labels = _lookup(parents, "parent", labels)
    return labels.select("image_id", "node", F.col("parent").alias("label"))


def region_labels(seams: DataFrame) -> DataFrame:
    """(image_id, node, label) for the labels of tiles whose region goes on in another tile (see :mod:`labelling`)."""
    return components(seams.filter("a_color = b_color").select("image_id", F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def _global(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Replaces a tile's label by its region's."""
    of = labels.select(F.col("image_id").alias("_image"), F.col("node").alias(column), F.col("label").alias("_whole"))
    return rows.join(of, ["_image", column], "left").withColumn(column, F.coalesce("_whole", column)).drop("_whole")


def _unpacked(color: Column) -> dict[str, Column]:
    return {c: F.shiftright(color, s).bitwiseAND(F.lit(255).cast("bigint")).cast("int") for c, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))}


def _areas(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    parts = tiles.filter(F.col("_kind") == L.REGION).select("_image", "_label", "_color", "_area", "_left", "_top", "_right", "_bottom")
    return _global(parts, labels, "_label").groupBy("_image", "_label").agg(
        F.sum("_area").alias("area"), F.min("_left").alias("left"), F.min("_top").alias("top"), F.max("_right").alias("right"),
        F.max("_bottom").alias("bottom"), F.first("_color").alias("_color"))


def color_regions(px: DataFrame, tile: int = L.TILE) -> DataFrame:
    """Area, bounding box and colour of every 4-connected region of equal colour; a region is named by its first pixel in scan order."""
    tiles = L.labelled_tiles(px, tile)
    colors = _unpacked(F.col("_color"))
    return _areas(tiles, region_labels(L.seams(tiles))).select(
        F.col("_image").alias("image_id"), F.shiftright("_label", 32).cast("int").alias("first_y"),
        F.col("_label").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("first_x"),
        "area", "left", "top", "right", "bottom", *[colors[c].alias(c) for c in "rgba"],
    )


def speckle_filter(px: DataFrame, min_area: int, tile: int = L.TILE) -> DataFrame:
    """Regions below ``min_area`` take the colour of the neighbour with the longest border.

    Ties go to the region that comes first in scan order; colours are those before the filter. Speckles that a tile
    knows whole, with all regions beside them, leave it repainted. Only pixels of parts that are small within their tile, and reach its edge
    or border a region that does, are looked up again.
    """
    if min_area <= 1:
        return px
    tiles = L.labelled_tiles(px, tile, min_area)
    # read three times: for regions over the seams, and for the borders of either side
    pairs = stored(L.seams(tiles).filter("a_color = b_color or a_small or b_small"), "seams")
    labels = stored(region_labels(pairs), "labels")
    small = stored(_areas(tiles, labels).filter(F.col("area") < min_area).select("_image", "_label"), "speckles")
    inside = tiles.filter(F.col("_kind") == L.BORDER).select("_image", "_label", "_other", "_color", "_length")
    over = lambda me, you: pairs.filter(f"{me}_small and a_color <> b_color").select(
        F.col("image_id").alias("_image"), F.col(me).alias("_label"), F.col(you).alias("_other"), F.col(f"{you}_color").alias("_color"),
        F.lit(1).cast("bigint").alias("_length"))
    borders = inside.unionByName(over("a", "b")).unionByName(over("b", "a"))
    borders = _global(_global(borders, labels, "_label"), labels, "_other").join(small, ["_image", "_label"], "left_semi")
    lengths = borders.groupBy("_image", "_label", "_other").agg(F.sum("_length").alias("_length"), F.first("_color").alias("_new"))
    chosen = lengths.groupBy("_image", "_label").agg(F.max_by("_new", F.struct(F.col("_length"), (-F.col("_other")).alias("o"))).alias("_new"))
    pixels = tiles.filter(F.col("_kind") == L.PIXEL)
    looked = _global(pixels.filter("_small").select("_image", "_label", *px.columns), labels, "_label").join(chosen, ["_image", "_label"], "left")
    made = _unpacked(F.col("_new"))
    repainted = looked.select(*[F.coalesce(made[c], c).alias(c) if c in made else F.col(c) for c in px.columns])
    return pixels.filter("not _small").select(*px.columns).unionByName(repainted)


# ---- SVG --------------------------------------------------------------------------------


def svg_lines(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, ord, line): the SVG document as rows, one per scan line, in order.

    ``sizes`` has width and height, and optionally orig_width and orig_height for images traced
    enlarged: they are shown at the former size through a view box. Invisible runs are left out.
    """
    s = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    hex2 = lambda c: F.lower(F.lpad(F.hex(F.col(c)), 2, "0"))
    alpha = F.when(F.col("a") < 255, hex2("a")).otherwise(F.lit(""))
    rect = text('<rect x="', s("x0"), '" y="', s("y"), '" width="', (F.col("x1") - F.col("x0") + 1).cast("string"),
                '" height="1" fill="#', hex2("r"), hex2("g"), hex2("b"), alpha, '"/>')
    body = (
        runs.filter("a > 0").groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x0", rect.alias("rect")))).alias("_r"))
        .select("image_id", (F.col("y") + 1).alias("ord"), F.array_join(F.transform("_r", lambda r: r["rect"]), "").alias("line"))
    )
    if "orig_width" not in sizes.columns:
        sizes = sizes.withColumns({"orig_width": F.col("width"), "orig_height": F.col("height")})
    same = (F.col("orig_width") == F.col("width")) & (F.col("orig_height") == F.col("height"))
    box = F.when(same, F.lit("")).otherwise(text(' viewBox="0 0 ', s("width"), " ", s("height"), '"'))
    head = text('<svg xmlns="http://www.w3.org/2000/svg" width="', s("orig_width"), '" height="', s("orig_height"), '"', box, ">")
    ends = sizes.select(
        "image_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("ord"), head.alias("line")),
            F.struct((F.col("height") + 1).alias("ord"), F.lit("</svg>").alias("line")),
        )).alias("_e"),
    ).select("image_id", "_e.ord", "_e.line")
    return ends.unionByName(body)


def svg_rects(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """One SVG text per image, put together from its finished lines (one per scan line).

    The whole text is one value by definition; for images whose text would not fit in a value,
    write :func:`svg_lines` sorted by ``ord`` instead.
    """
    lines = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return svg_lines(runs, sizes).groupBy("image_id").agg(
        F.array_join(F.transform(lines, lambda l: l["line"]), "\n").alias("svg")
    )
