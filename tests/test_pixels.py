"""Properties and brute-force checks of the pixel operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.operators import pixels_geometry as G
from rasterloom.operators import pixels_neighborhood as N
from rasterloom.operators import pixels_point as P
from rasterloom.operators import planning as L
from rasterloom.operators import regions as R
from rasterloom.operators import tiles as T


def make(spark, arrays):
    rows = [(i, y, x, *map(int, a[y, x]), a.shape[1], a.shape[0]) for i, a in arrays.items()
            for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, schemas.SIZED_PIXELS)


def back(df, key="image_id"):
    out = {}
    for r in df.collect():
        k = r[key]
        if k not in out:
            out[k] = np.full((r.height, r.width, 4), -1)
        assert out[k][r.y, r.x, 0] == -1, "pixel twice"
        out[k][r.y, r.x] = (r.r, r.g, r.b, r.a)
    assert all((a >= 0).all() for a in out.values()), "pixel missing"
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    return {0: rng.integers(0, 256, (5, 9, 4)), 1: rng.integers(0, 256, (13, 4, 4)), 2: rng.integers(0, 3, (20, 21, 4)) * 100,
            3: rng.integers(0, 256, (1, 1, 4))}


@pytest.fixture(scope="module")
def px(spark, arrays):
    return make(spark, arrays).cache()


def same(a, b):
    return a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_turns(px, arrays):
    assert same(back(G.rotate_flip(px, 90)), {k: np.rot90(a, -1) for k, a in arrays.items()})
    assert same(back(G.rotate_flip(px, 180, flip_v=True)), {k: np.rot90(a[::-1], 2) for k, a in arrays.items()})
    assert same(back(G.rotate_flip(px, 270, flip_h=True)), {k: np.rot90(a[:, ::-1], 1) for k, a in arrays.items()})
    four = px
    for _ in range(4):
        four = G.rotate_flip(four, 90)
    assert same(back(four), arrays)


def test_orientation(px, arrays):
    upright = {
        1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: np.rot90(a, 2), 4: lambda a: a[::-1],
        5: lambda a: a.transpose(1, 0, 2), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).transpose(1, 0, 2),
        8: lambda a: np.rot90(a, 1),
    }
    for o, f in upright.items():
        assert same(back(G.orient_normalize(px.withColumn("orientation", F.lit(o)))), {k: f(a) for k, a in arrays.items()})


def test_crop_and_identity(px, arrays):
    assert same(back(G.crop_pixels(px, 0, 0, 1, 1)), arrays)
    seen = {k: np.where(a[..., 3:] == 0, 0, a) for k, a in arrays.items()}
    assert same(back(G.resample(px, F.col("width"), F.col("height"))), seen)
    assert same(back(G.resample(px, F.col("width"), F.col("height"), method="nearest")), arrays)
    assert same(back(T.tile_stitch(T.tile_explode(px, 4, 2), 4)), arrays)


def test_margin_and_icon(px, arrays):
    got = back(G.margin_paint(px, "px", top=1, right=2, bottom=0, left=3, color="#010203", opacity=50))
    want = {k: np.pad(a, ((1, 0), (3, 2), (0, 0)), constant_values=-1) for k, a in arrays.items()}
    for a in want.values():
        a[a[..., 0] == -1] = (1, 2, 3, 128)
    assert same(got, want)
    icons = back(G.icon_render(px, 16))
    assert all(a.shape == (16, 16, 4) for a in icons.values())
    assert (icons[0][0, :, 3] == 0).all() and (icons[1][:, 0, 3] == 0).all()


@pytest.mark.parametrize("direction,resize", [("vertical", "none"), ("horizontal", "none"), ("vertical", "fill")])
def test_merge(spark, px, arrays, direction, resize):
    members = spark.createDataFrame([("z", i, i, a.shape[1], a.shape[0]) for i, a in arrays.items()],
                                    "album string, pos int, image_id bigint, width int, height int")
    layout = L.merge_layout(members, direction, "center", resize)
    canvas = back(G.merge_images(px, layout, direction, None, resize), "album")["z"]
    place = {r.image_id: r for r in layout.collect()}
    assert canvas.shape[:2] == (place[0].canvas_height, place[0].canvas_width)
    for i, a in arrays.items():
        p = place[i]
        if (p.draw_height, p.draw_width) == a.shape[:2]:
            spot = canvas[p.place_y : p.place_y + a.shape[0], p.place_x : p.place_x + a.shape[1]]
            assert np.array_equal(spot, a if resize == "none" else np.where(a[..., 3:] == 0, 0, a))
    painted = back(G.merge_images(px, layout, direction, "#ffffff", resize), "album")["z"]
    assert (painted[..., 3] == 255).all()


def test_background_key(spark):
    white, gray, black = [255] * 4, [215, 215, 215, 255], [0, 0, 0, 255]
    px = make(spark, {0: np.array([[white, gray, black]])})
    assert back(P.background_key(px, "#ffffff", 10, 0))[0][0, :, 3].tolist() == [0, 255, 255]
    assert 0 < back(P.background_key(px, "#ffffff", 10, 30))[0][0, 1, 3] < 255
    assert back(P.background_key(px, "#ffffff", 100, 0))[0][0, 2, 3] == 255


def test_sharpen(spark, px, arrays):
    flat = make(spark, {0: np.full((3, 3, 4), 100) + np.array([0, 0, 0, 100])})
    assert (back(N.sharpen(flat, 0.8))[0] == [100, 100, 100, 200]).all()
    assert same(back(N.sharpen(px, 0.3, tile=4)), back(N.sharpen(px, 0.3)))


@pytest.mark.parametrize("tile", [4, 256])
def test_windows_against_numpy(px, arrays, tile):
    median, mode = back(N.median3(px, tile)), back(N.mode5(px, tile))
    for k, a in arrays.items():
        h, w = a.shape[:2]
        pad = np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
        for y in range(h):
            for x in range(w):
                for c in range(3):
                    assert median[k][y, x, c] == np.median(pad[y : y + 3, x : x + 3, c])
                    v, n = np.unique(a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3, c], return_counts=True)
                    assert mode[k][y, x, c] == (v[n.argmax()] if n.max() > 2 else a[y, x, c])


def test_wide_blur_keeps_flat_images(spark):
    flat = make(spark, {0: np.full((7, 9, 4), 90)})
    assert (back(N.gaussian_blur(flat, 20, tile=4))[0] == 90).all()
    assert (back(N.gaussian_blur(flat, 0))[0] == 90).all()


def test_resample_keeps_flat_colours(spark):
    flat = make(spark, {0: np.full((7, 9, 4), 90)})
    for df in (G.resample(flat, 5, 3), G.resample(flat, 20, 3), G.resample_lanczos(flat, 4)):
        out = back(df)[0]
        assert (out[..., 3] == 90).all() and (abs(out[..., 0] - 90) <= 1).all()


def test_inference_matches_whole_image(px, arrays):
    tiled, whole = (back(T.tiled_inference(px, tile=t, pad=3)) for t in (4, 64))
    for k, a in arrays.items():
        assert np.array_equal(tiled[k], whole[k])
        assert np.array_equal(tiled[k][..., :3], a[..., :3].repeat(4, 0).repeat(4, 1))


def flood(a):
    label = np.full(a.shape[:2], -1)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if label[y, x] < 0:
                stack, label[y, x] = [(y, x)], y * a.shape[1] + x
                while stack:
                    i, j = stack.pop()
                    for v, u in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                        if 0 <= v < a.shape[0] and 0 <= u < a.shape[1] and label[v, u] < 0 and (a[v, u] == a[i, j]).all():
                            label[v, u] = y * a.shape[1] + x
                            stack.append((v, u))
    return label


def test_regions_against_flood_fill(spark):
    random.seed(1)
    spiral = np.zeros((15, 15), int)
    for i in range(0, 15, 2):
        spiral[i, :] = 1
        if i + 1 < 15:
            spiral[i + 1, 14 if i % 4 == 0 else 0] = 1
    noise = np.array([[random.randint(0, 1) for _ in range(30)] for _ in range(30)])
    arrays = {i: np.stack([m * 255, m, m, m * 0 + 255], -1) for i, m in enumerate((spiral, noise, noise * 0))}
    px = make(spark, arrays)
    got = {(r.image_id, r.first_y, r.first_x): r.area for r in R.color_regions(px).collect()}
    want = {}
    for i, a in arrays.items():
        label = flood(a)
        for first, n in zip(*np.unique(label, return_counts=True)):
            want[(i, first // a.shape[1], first % a.shape[1])] = n
    assert got == want
    assert R.speckle_filter(px, 1).exceptAll(px).count() == 0


@pytest.mark.parametrize("tile,least", [(256, 6), (8, 6), (5, 40), (3, 3)])
def test_regions_over_tiles(spark, tile, least):
    """Regions and speckles are the same however the image is cut."""
    rng = np.random.default_rng(tile)
    a = np.repeat(np.repeat(rng.integers(0, 3, (9, 7)), 3, 0), 4, 1)
    a[rng.random(a.shape) < 0.08] = 3
    image = np.stack([a * 80, a * 10, a * 0, 255 - a], -1)
    px, label = make(spark, {4: image}), flood(image)
    got = {(r.first_y * a.shape[1] + r.first_x): (r.area, r.left, r.top, r.right, r.bottom) for r in R.color_regions(px, tile).collect()}
    want = {}
    for first in np.unique(label):
        y, x = np.nonzero(label == first)
        want[int(first)] = (len(y), x.min(), y.min(), x.max(), y.max())
    assert got == want
    area, border = dict(zip(*np.unique(label, return_counts=True))), {}
    for y, x in np.ndindex(*a.shape):
        for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= v < a.shape[0] and 0 <= u < a.shape[1] and label[v, u] != label[y, x] and area[label[y, x]] < least:
                key = (label[y, x], label[v, u])
                border[key] = border.get(key, 0) + 1
    repainted = image.copy()
    for small in {k[0] for k in border}:
        other = max((n, -b) for (s, b), n in border.items() if s == small)
        repainted[label == small] = image[np.unravel_index(-other[1], a.shape)]
    assert same(back(R.speckle_filter(px, least, tile)), {4: repainted}) and (repainted != image).any()


def test_regions_of_incomplete_images(spark):
    """Missing pixels belong to no region and join none."""
    px = make(spark, {1: np.zeros((6, 9, 4), int)}).filter("x <> 4 and not (y = 2 and x < 4)")
    got = {(r.first_y, r.first_x): r.area for r in R.color_regions(px, 4).collect()}
    assert got == {(0, 0): 8, (3, 0): 12, (0, 5): 24}
    assert R.color_regions(px.filter("false")).isEmpty() and R.speckle_filter(px.filter("false"), 3).isEmpty()
    assert R.speckle_filter(px, 100, 4).exceptAll(px).isEmpty()


def test_speckles_inside_a_tile_stay_in_it(spark):
    """Finding F16: what a tile knows whole is no row of the next level, however many speckles there are."""
    from rasterloom.operators import labelling

    noise = np.random.default_rng(16).integers(0, 256, (20, 20, 4))
    facts = labelling.labelled_tiles(make(spark, {4: noise, 7: noise // 90}), 32, 3).groupBy("_kind", "_small").count().collect()
    assert [tuple(r) for r in facts] == [(labelling.PIXEL, False, 800)]


def test_tiles_are_labelled_together(spark):
    """Finding F17: one call takes all tiles of a batch; batches may cut tiles anywhere."""
    from rasterloom.operators import labelling

    y, x = (v.ravel() for v in np.indices((16, 16)))
    labels, *_ = labelling.tile_facts(y // 8 * 2 + x // 8, y * 0 + 5, y, x, y * 0 + 9, 8, 0)
    assert set(labels.tolist()) == {0, 8, 8 << 32, (8 << 32) + 8}
    rng = np.random.default_rng(17)
    arrays = {i: np.stack([rng.integers(0, 3, (9 + i % 5, 11))] * 4, -1) for i in range(30)}
    px = make(spark, arrays).select("image_id", "y", "x", *"rgba", "width", "height")
    want = back(R.speckle_filter(px, 4, 64))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert same(back(R.speckle_filter(px, 4, 4)), want) and not same(want, arrays)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("tile", [3, 8, 128])
def test_kernels_do_not_depend_on_tiles(spark, px, arrays, tile):
    from rasterloom.operators import tile_kernels as K

    wanted = {"mode": back(K.filtered(px, 2, K.mode5)), "median": back(K.filtered(px, 1, K.median3)), "large": back(K.enlarged(px, F.lit(3)))}
    assert same(back(N.mode5(px, tile)), wanted["mode"]) and same(back(N.median3(px, tile)), wanted["median"])
    assert same(back(K.enlarged(px, F.lit(3), tile)), wanted["large"])
    for i, a in arrays.items():
        for y, x in np.ndindex(*a.shape[:2]):
            near = a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].reshape(-1, 4)
            for c in range(3):
                values, often = np.unique(near[:, c], return_counts=True)
                assert wanted["mode"][i][y, x, c] == (values[often.argmax()] if often.max() > 2 else a[y, x, c])


def test_quantize_limits_colours(px):
    counts = R.quantize(px).select("image_id", "r", "g", "b").distinct().groupBy("image_id").count().collect()
    assert all(r["count"] <= 16 for r in counts)


def test_marginal_cuts_equal_window_cuts(spark):
    """Palettes split on channel sums are those split in windows: hot colours, single colours, ties."""
    rng = np.random.default_rng(12)
    rows = []
    for image in range(12):
        top = int(rng.choice([1, 2, 4, 40, 256]))
        colors = {tuple(int(v) for v in rng.integers(0, top, 3)) for _ in range(int(rng.choice([1, 2, 5, 90])))}
        rows += [(image, *c, int(rng.choice([1, 1, 3, 1000]))) for c in colors]
    histogram = spark.createDataFrame(rows, "image_id bigint, r int, g int, b int, n bigint")
    boxes = lambda limit: sorted(map(tuple, R.median_cut(histogram, 3, limit).collect()))
    want = boxes(1000)
    assert boxes(0) == want and boxes(4) == want and len(want) == len(rows)
    assert R.median_cut(histogram.filter("false"), 2, 0).isEmpty()


def test_trace_prepare_sizes(spark):
    logo = np.zeros((10, 12, 4), int) + [0, 0, 0, 255]
    logo[2:5, 3:8, 0] = 255
    rng = np.random.default_rng(9)
    arrays = {0: logo, 1: logo - [0, 0, 0, 55], 2: np.concatenate([rng.integers(0, 256, (12, 12, 3)), np.full((12, 12, 1), 9)], -1)}
    out = back(R.trace_prepare(make(spark, arrays)))
    assert out[0].shape[:2] == (40, 48) and out[1].shape[:2] == (40, 48) and out[2].shape[:2] == (12, 12)
    assert (out[2][..., 3] == 255).all() and (out[1][..., 3] == 200).all()
