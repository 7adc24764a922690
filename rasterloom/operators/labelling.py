"""Two-level labelling of equal-colour regions: inside tiles first, then over the seams between them.

One shuffle brings the pixels of a tile together. A kernel labels tiles by joining runs of their lines, so a label is the
region's first pixel in scan order, and reports what the next level needs: one row per region, the pixels on
the tile's edges, and how long regions of different colour border each other. A speckle inside a tile, among regions inside the
tile, is settled there. Everything after that works on those rows:
seams pair the edge pixels of neighbouring tiles, the few pairs of one colour are contracted to components, and sums per
region are added up. No window or task ever sees a whole row or column of an image.

Pixels that are missing belong to no region and separate their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions.rounding import idiv
from rasterloom.functions.scale import by_key, stored
from rasterloom.functions.ship import ship_package

TILE = 256
PIXEL, REGION, SEAM, BORDER = 0, 1, 2, 3
CHANNELS = "argb"
FACTS = (
    "_kind byte, _image bigint, _label bigint, _small boolean, _color bigint, _area bigint, _left int, _top int, _right int, _bottom int, "
    "_other bigint, _length bigint, _across boolean, _seam int, _at int, _second boolean")


def region_heads(key: np.ndarray, color: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every cell the number of its 4-connected region's first cell, and the pairs (one, next) of cells beside each other.

    ``key`` ascends without repeats: tile by tile, within a tile in scan order. Any number of tiles is labelled at once.
    """
    beside = np.flatnonzero((key[1:] == key[:-1] + 1) & (key[1:] % tile > 0))
    above = np.flatnonzero(key // tile % tile < tile - 1)
    below = np.minimum(np.searchsorted(key, key[above] + tile), len(key) - 1)
    met = key[below] == key[above] + tile
    above, below = above[met], below[met]
    start = np.ones(len(key), bool)
    start[beside[color[beside] == color[beside + 1]] + 1] = False
    run, cell = np.cumsum(start) - 1, np.flatnonzero(start)
    touch = color[above] == color[below]
    pairs = np.unique(run[above[touch]] * len(cell) + run[below[touch]])
    upper, lower = pairs // len(cell), pairs % len(cell)
    parent = np.arange(len(cell))
    while True:
        a, b = parent[upper], parent[lower]
        differ = a != b
        if not differ.any():
            return cell[parent][run], np.concatenate((beside, above)), np.concatenate((beside + 1, below))
        upper, lower, a, b = upper[differ], lower[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tile_facts(
    number: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, color: np.ndarray, tile: int, small: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Labels of the pixels of tiles, whether the next level must look them up, their colours, and the rows for the next level.

    ``number`` tells the tiles apart. With ``small``, a part below it is settled here, and its pixels take their colour, where neither it nor
    a region beside it reaches the tile's edge: then all of them are known whole. Only the others, and what reaches an edge, go on.
    """
    key = (number * tile + y % tile) * tile + x % tile
    order = np.argsort(key, kind="stable")
    last = np.append(key[order][1:] != key[order][:-1], True)
    at = order[last]
    cell = np.empty(len(key), np.int64)
    cell[order] = np.cumsum(last) - last
    paint, cy, cx = color[at], y[at], x[at]
    head, one, two = region_heads(key[at], paint, tile)
    label = ((cy << 32) + cx)[head]
    area = np.bincount(head, minlength=len(at))
    little = area < small
    # Pixels beside a neighbouring tile; those before a seam and those behind it meet at the seam's place.
    rows, open_ = [], np.zeros(len(at), bool)
    for axis, other, across in ((cx, cy, True), (cy, cx, False)):
        for edge, second in ((tile - 1, False), (0, True)):
            on = np.flatnonzero((axis % tile == edge) & (axis + 1 - second > 0))
            open_[head[on]] = True
            rows.append({
                "_kind": SEAM, "_image": image[at[on]], "_label": label[on], "_small": little[head[on]], "_color": paint[on], "_across": np.full(len(on), across),
                "_seam": (axis[on] + 1 - second).astype(np.int32), "_at": other[on].astype(np.int32), "_second": np.full(len(on), second)})
    known, wait = np.ones(len(at), bool), np.zeros(len(at), bool)
    if small:
        me, you = np.concatenate((head[one], head[two])), np.concatenate((head[two], head[one]))
        border = (me != you) & little[me]
        sides, length = np.unique(me[border] * len(at) + you[border], return_counts=True)
        own, other = sides // len(at), sides % len(at)
        wait = little & open_
        wait[own[open_[other]]] = True
        known = open_ | wait
        on = wait[own]
        rows.append({
            "_kind": BORDER, "_image": image[at[own[on]]], "_label": label[own[on]], "_other": label[other[on]], "_color": paint[other[on]],
            "_length": length[on]})
        own, other, length = own[~on], other[~on], length[~on]
        best = np.lexsort((other, -length, own))
        best = best[np.append(True, own[best][1:] != own[best][:-1])] if len(best) else best
        made = paint.copy()
        made[own[best]] = paint[other[best]]
    else:
        made = paint
    mine = head[cell]
    told = np.flatnonzero(known[mine])
    told = told[np.argsort(mine[told], kind="stable")]
    heads = np.flatnonzero(np.append(True, mine[told][1:] != mine[told][:-1])) if len(told) else told
    first = mine[told[heads]]
    span = lambda f, v: (f.reduceat(v[told], heads) if len(told) else v[told]).astype(np.int32)
    rows.append({
        "_kind": REGION, "_image": image[at[first]], "_label": label[first], "_color": paint[first], "_area": np.diff(np.append(heads, len(told))),
        "_left": span(np.minimum, x), "_top": span(np.minimum, y), "_right": span(np.maximum, x), "_bottom": span(np.maximum, y)})
    for r in rows:
        r["_kind"] = np.full(len(r["_label"]), r["_kind"], np.int8)
    return label[cell], wait[mine], np.where(made[mine] == paint[mine], color, made[mine]), rows


def _whole_tiles(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tiles, and the number of every row's tile in them, from batches sorted by tile."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
        starts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1
        begun = held and key == tuple(columns[:, 0])
        key = tuple(columns[:, -1])
        if held and (len(starts) or not begun):
            last = int(starts[-1]) if len(starts) else 0
            yield _numbered(pa.Table.from_batches([*held, batch.slice(0, last)]), keys)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _numbered(pa.Table.from_batches(held), keys)


def _numbered(table: pa.Table, keys: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    columns = np.stack([table.column(k).to_numpy() for k in keys])
    return table, np.append(0, np.cumsum((columns[:, 1:] != columns[:, :-1]).any(0)))


def labelled_tiles(px: DataFrame, tile: int = TILE, small: int = 0) -> DataFrame:
    """The table of both levels' input, written once: rows of :data:`FACTS`, and the pixels (all columns) if ``small`` is given.

    The tiles of a batch are labelled at once, so that small ones cost no call each; only a tile that a batch cuts is held back.
    """
    ship_package(px.sparkSession)
    names = px.columns
    facts_only = StructType.fromDDL(FACTS)
    schema = StructType([*px.schema.fields, *facts_only.fields]) if small else facts_only
    arrow, arrow_facts = to_arrow_schema(schema), to_arrow_schema(facts_only)
    keys = ("image_id", "_ty", "_tx")

    def table(columns: dict, n: int, fields: pa.Schema) -> dict:
        return {f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, number in _whole_tiles(batches, keys):
            get = lambda c: group.column(c).to_numpy()
            color = np.zeros(len(number), np.int64)
            for c in CHANNELS:
                color = (color << 8) | get(c)
            image = get("image_id")
            mine, wait, made, rows = tile_facts(number, image, get("y").astype(np.int64), get("x").astype(np.int64), color, tile, small)
            parts = [pa.table(table(r, len(r["_label"]), arrow), arrow) for r in rows if len(r["_label"])]
            if small:
                facts = {"_kind": np.full(len(mine), PIXEL, np.int8), "_image": image, "_label": mine, "_small": wait}
                changed = {c: np.where(made == color, get(c), made >> s & 255) for c, s in zip(CHANNELS, (24, 16, 8, 0))}
                own = {c: pa.array(changed[c], arrow.field(c).type) if c in changed else group.column(c) for c in names}
                parts.append(pa.table(own | table(facts, len(mine), arrow_facts), arrow))
            for part in parts:
                yield from part.to_batches()

    tiled = px if small else px.select("image_id", "y", "x", *CHANNELS)
    tiled = tiled.withColumns({"_ty": idiv(F.col("y"), tile).cast("int"), "_tx": idiv(F.col("x"), tile).cast("int")})
    return stored(by_key(tiled, *keys).sortWithinPartitions(*keys).mapInArrow(label, schema), "tiles")


def seams(tiles: DataFrame) -> DataFrame:
    """(image_id, a, b, a_color, b_color, a_small, b_small): the pairs of pixels beside each other in two tiles, once each."""
    # a side has one pixel at a place; plain maxima of its columns are added up by hash, those of a struct would be sorted
    side = {"a": ~F.col("_second"), "b": F.col("_second")}
    facts = [(s, c, s if c == "label" else f"{s}_{c}") for s in "ab" for c in ("label", "color", "small")]
    met = tiles.filter(F.col("_kind") == SEAM).groupBy("_image", "_across", "_seam", "_at").agg(
        *[F.max(F.when(side[s], F.col(f"_{c}"))).alias(name) for s, c, name in facts])
    return met.filter("a is not null and b is not null").select(F.col("_image").alias("image_id"), *[name for *_, name in facts])
