"""Properties of detected text, on the fold and on the routes for huge bands."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.operators import ocr as O


WORDS = "image_id bigint, pass int, seq int, text string, confidence double, left_px int, top_px int, width_px int, height_px int"


def clash(a, b):
    """Whether two boxes (left, top, width, height) share more than half of the area they cover together."""
    cells = lambda box: np.array([box[0], box[1], box[0] + box[2], box[1] + box[3]])
    one, two = cells(a), cells(b)
    common = np.prod(np.clip(np.minimum(one, two)[2:] - np.maximum(one, two)[:2], 0, None))
    return 3 * common > a[2] * a[3] + b[2] * b[3]


def check_page(words, lined, text):
    """Properties of a page. ``words``: rank -> (box, text), best first; ``lined``: rank -> line."""
    kept = [r for r in words if r in lined]
    dropped = [r for r in words if r not in lined]
    assert not any(clash(words[a][0], words[b][0]) for a, b in itertools.combinations(kept, 2))
    order = {r: i for i, r in enumerate(words)}
    assert all(any(order[k] < order[d] and clash(words[k][0], words[d][0]) for k in kept) for d in dropped)
    # From top to bottom, a word joins the first line whose extent holds its middle, else it opens one.
    extent: list = []
    for r in sorted(kept, key=lambda r: (words[r][0][1], words[r][0][0], order[r])):
        (_, top, _, height), line = words[r][0], lined[r]
        twice = 2 * top + height
        holds = [2 * lo <= twice <= 2 * hi for lo, hi in extent]
        assert line == (holds.index(True) if any(holds) else len(extent))
        extent[line : line + 1] = [(min(top, *extent[line][:1]), max(top + height, extent[line][1]))] if line < len(extent) else [(top, top + height)]
    rows = [[words[r][1] for r in sorted((r for r in kept if lined[r] == line), key=lambda r: (words[r][0][0], words[r][0][1], order[r]))]
            for line in range(len(extent))]
    assert [row.split(" ") for row in text.split("\n")] == (rows or [[""]])


def pages(seed):
    rng = random.Random(seed)
    out = {}
    for image in range(6):
        n = rng.choice([0, 1, 30, 120])
        words = []
        for i in range(n):
            kind = rng.random()
            if kind < 0.1 and words:  # exact copies and near copies
                box = list(words[rng.randrange(len(words))][2:6])
                box[0] += rng.choice([0, 0, 1])
            elif kind < 0.13:
                box = [rng.randrange(100), rng.randrange(50), rng.randrange(5, 300), rng.randrange(200, 600)]
            elif kind < 0.16:
                box = [rng.randrange(300), rng.randrange(300), rng.choice([0, 10]), 0]
            else:
                box = [rng.randrange(300), rng.randrange(400), rng.randrange(4, 60), rng.randrange(4, 20)]
            words.append((float(rng.randrange(30, 60)), (rng.randrange(2), i), *box, f"w{i}"))
        out[image] = words
    return out


@pytest.mark.parametrize("seed,limit", [(1, 10_000), (2, 12), (3, 0)])
def test_dedup_lines_text(spark, seed, limit):
    data = pages(seed)
    rows = [(i, p, s, t, c, l, tp, w, h) for i, ws in data.items() for c, (p, s), l, tp, w, h, t in ws]
    words = spark.createDataFrame(rows, WORDS)
    lined = O.ocr_lines(O.ocr_dedup(words, limit), limit).collect()
    texts = {r.image_id: r.text for r in O.ocr_text(words, limit).collect()}
    for image, ws in data.items():
        ranked = {w[1]: (w[2:6], w[6]) for w in sorted(ws, key=lambda w: (-w[0], w[1]))}
        check_page(ranked, {(r["pass"], r.seq): r.line for r in lined if r.image_id == image}, texts.get(image, ""))


def test_known_page(spark):
    boxes = [("Hello", 90.0, 10, 10, 50, 12), ("world", 80.0, 70, 12, 50, 12), ("Hella", 60.0, 11, 10, 50, 12),
             ("below", 85.0, 10, 40, 40, 10), ("left", 70.0, 0, 41, 8, 10), ("tail", 50.0, 60, 39, 30, 10)]
    words = spark.createDataFrame([(1, 0, i, t, c, *box) for i, (t, c, *box) in enumerate(boxes)], WORDS)
    for limit in (10_000, 0):
        assert [r.text for r in O.ocr_text(words, limit).collect()] == ["Hello world\nleft below tail"]


def plain_iou(a, b):
    width, height = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    return width * height / (a[2] * a[3] + b[2] * b[3] - width * height) if width * height else 0.0


@pytest.mark.parametrize("limits", [{}, {"limit": 0}, {"island_limit": 4}])
def test_best_rivals_of_any_size(spark, limits):
    rng = random.Random(4)
    boxes = [(rng.randrange(-50, 400), rng.randrange(400), rng.randrange(0, 200), rng.randrange(0, 300)) for _ in range(250)]
    boxes += [(l + rng.randrange(-2, 3), t, w + rng.randrange(2), h) for l, t, w, h in boxes[:60]] + boxes[10:40]
    rows = [(7, i % 2, i, "t", 50.0, *b) for i, b in enumerate(boxes)]
    got = {r["seq"]: r for r in O.iou_pairs(spark.createDataFrame(rows, WORDS), **limits).collect()}
    first = {}
    for name, box in sorted(((i % 2, i), b) for i, b in enumerate(boxes)):
        first.setdefault(box, name)
    assert len(got) == len(boxes)
    for i, box in enumerate(boxes):
        rivals = [(plain_iou(box, other), -name[0], -name[1]) for other, name in first.items() if other != box and clash(box, other)]
        best = max(rivals, default=None)
        r = got[i]
        assert (r["class_pass"], r["class_seq"]) == first[box] and r["class_words"] == boxes.count(box)
        assert (r["iou"], r["rival_pass"], r["rival_seq"]) == ((None, None, None) if best is None else (best[0], -best[1], -best[2]))
    assert sum(r["iou"] is not None for r in got.values()) > 60


def test_many_equal_boxes_do_not_pair_up(spark):
    words = spark.range(50_000).selectExpr(
        "1L as image_id", "0 as pass", "cast(id as int) as seq", "'t' as text", "50D as confidence", "5 as left_px", "6 as top_px", "20 as width_px", "9 as height_px")
    row = O.iou_pairs(words.unionByName(words.limit(1).withColumns({"seq": F.lit(60_000), "left_px": F.lit(6)}))).groupBy(
        "class_seq", "class_words", "rival_seq").count().collect()
    assert sorted(map(tuple, row)) == [(0, 50_000, 60_000, 50_000), (60_000, 1, 0, 1)]


@pytest.mark.parametrize("seed,limit", [(4, 10_000), (5, 12), (6, 0)])
def test_page_in_one_pass(spark, seed, limit):
    rows = [(i, p, s, t, c, l, tp, w, h) for i, ws in pages(seed).items() for c, (p, s), l, tp, w, h, t in ws]
    words = spark.createDataFrame(rows, WORDS)
    page = O.ocr_page(words, limit)
    assert sorted(map(tuple, page.collect())) == sorted(map(tuple, O.ocr_lines(O.ocr_dedup(words)).collect()))
    assert sorted(map(tuple, O.page_text(page).collect())) == sorted(map(tuple, O.ocr_text(words).collect()))


def test_line_edges():
    rng = random.Random(1)
    for _ in range(40):
        edges, low = O.LineEdges(), []
        for top in sorted(rng.randrange(500) for _ in range(300)):
            height = rng.choice([0, 1, 5, 7, 40, 300])
            hit = next((i for i, v in enumerate(low) if v * 2 >= top * 2 + height), len(low))
            low[hit : hit + 1] = [max(top + height, *low[hit : hit + 1])] if hit < len(low) else [top + height]
            assert edges.put(top, height) == hit


def test_very_many_lines_in_a_band():
    """A tall box keeps the band together while a hundred thousand lines open in it."""
    import time

    edges, began = O.LineEdges(), time.time()
    assert edges.put(0, 10) == 0
    lines = [edges.put(i * 12, 10) for i in range(1, 100_000)]
    assert lines == list(range(1, 100_000)) and time.time() - began < 20


def test_filter(spark):
    rows = [(1, 0, i, lvl, t, c, 0, 0, 1, 1) for i, (lvl, t, c) in enumerate([
        (5, " a\t", "30"), (5, "b", "29.99"), (4, "c", "90"), (5, " ", "90"), (5, "d", "n/a"), (5, "e", "96.25"), (5, "f", None)])]
    got = O.ocr_filter(spark.createDataFrame(rows, schemas.DETECTIONS)).collect()
    assert [(r.text, r.confidence) for r in got] == [("a", 30.0), ("e", 96.2)]


def test_result_and_fractions(spark):
    images = spark.createDataFrame([(1, "a.png", 200, 100), (2, "b.png", 0, 0), (3, "c.png", 9, 9)],
                                   "image_id bigint, file_name string, width int, height int")
    words = spark.createDataFrame(
        [(1, 0, 0, "hi", 90.0, 10, 20, 40, 10), (1, 0, 1, "you", 80.0, 60, 21, 40, 10), (2, 0, 0, "z", 70.0, 3, 4, 5, 6)],
        "image_id bigint, pass int, seq int, text string, confidence double, left_px int, top_px int, width_px int, height_px int")
    rows = {r.image_id: r for r in O.ocr_result(images, O.ocr_lines(words), O.ocr_text(words)).collect()}
    first = rows[1].words[0]
    assert (first["left"], first["top"], first["width"], first["height"]) == (0.05, 0.2, 0.2, 0.1)
    assert rows[1].text == "hi you" and rows[2].words[0]["left"] == 3.0 and rows[3].text == "" and rows[3].words == []


def test_text_names(spark):
    names = ["a.png", "a.jpg", "b", "b.txt", "a.png"]
    df = spark.createDataFrame([("z", i, n) for i, n in enumerate(names)], "album string, pos int, file_name string")
    for block in (1, 100):
        got = O.text_names(df, rows_per_block=block).orderBy("pos").select("text_name").collect()
        assert [r[0] for r in got] == ["a.txt", "a-2.txt", "b.txt", "b-2.txt", "a-3.txt"]


def page_words(spark, seed):
    rows = [(i, p, s, t, c, l, tp, w, h) for i, ws in pages(seed).items() for c, (p, s), l, tp, w, h, t in ws]
    return spark.createDataFrame(rows, WORDS)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_usual_images_are_shuffled_once(spark):
    words = page_words(spark, 4)
    for out in (O.ocr_page(words), O.ocr_dedup(words), O.ocr_text(words), O.iou_links(words)):
        assert exchanges(out) == 1
    sizes = O.large_images(words)
    assert sizes.large is None and exchanges(O.ocr_lines(O.ocr_dedup(words, sizes=sizes), sizes=sizes)) == 1


def test_streamed_lines_stay_where_duplicates_were_removed(spark):
    words = page_words(spark, 4)
    kept = O.ocr_dedup(words, sizes=O.large_images(words))
    sizes = O.large_images(words, 0)
    assert sizes.all_large and sizes.all_few and not O.large_images(words, 0, image_limit=60).all_few
    streamed = O.ocr_lines(kept, 0, sizes)
    assert exchanges(streamed) == 1 and sorted(map(tuple, streamed.collect())) == sorted(map(tuple, O.ocr_page(words).collect()))
    apart = O.ocr_lines(kept, 0, O.large_images(words, 0, image_limit=60))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, streamed.collect()))


def test_result_gathers_words_once(spark):
    words = page_words(spark, 4)
    images = words.select("image_id").distinct().withColumns({"file_name": F.lit("f"), "width": F.lit(300), "height": F.lit(0)})
    page = O.ocr_page(words)
    one, two = O.ocr_result(images, page), O.ocr_result(images, page, O.page_text(page))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert exchanges(O.ocr_result(spark.createDataFrame([(0, "f", 1, 1)], images.schema), page)) <= 4


def test_large_images_beside_others(spark):
    words = page_words(spark, 4)
    rows = lambda df: sorted(map(tuple, df.collect()))
    sizes = O.large_images(words, image_limit=60)
    assert 0 < sizes.large.count() < 6 and not sizes.all_large
    assert rows(O.ocr_page(words, sizes=sizes)) == rows(O.ocr_page(words)) == rows(O.ocr_lines(O.ocr_dedup(words, sizes=sizes), sizes=sizes))
    assert rows(O.ocr_text(words, sizes=sizes)) == rows(O.ocr_text(words))
    assert rows(O.iou_links(words, sizes=sizes)) == rows(O.iou_links(words))


@pytest.mark.parametrize("limit", [10_000, 0])
def test_all_pairs_of_similar_boxes(spark, limit):
    rng = random.Random(5)
    boxes = [(rng.randrange(-50, 400), rng.randrange(400), rng.randrange(0, 200), rng.randrange(0, 300)) for _ in range(200)]
    boxes += [(l + rng.randrange(-2, 3), t, w + rng.randrange(2), h) for l, t, w, h in boxes[:60]] + boxes[10:40]
    rows = [(7, i % 2, i, "t", 50.0, *b) for i, b in enumerate(boxes)]
    got = sorted(tuple(r) for r in O.iou_links(spark.createDataFrame(rows, WORDS), limit).collect())
    names = sorted((i % 2, i) for i in range(len(boxes)))
    assert got == [(7, *a, *b, plain_iou(boxes[a[1]], boxes[b[1]])) for a, b in itertools.combinations(names, 2) if clash(boxes[a[1]], boxes[b[1]])]
    assert len(got) > 90


def test_pairs_query_lists_more_than_the_best_rival():
    import __spark_entry__ as entry

    assert "pass_b" in entry.oracle_sql()["iou_pairs"] and "rival_pass" not in entry.oracle_sql()["iou_pairs"]


def test_forced_routes_list_no_word_in_several_cells(spark):
    """Findings F2, F5, F7: images with bands of any size are shuffled once, by image."""
    words = spark.createDataFrame([(image, 0, i, "w", 50.0 + i % 7, 25 * (i % 40), 4 * (i % 100 // 40), 20, 10) for image in range(3) for i in range(200)], WORDS)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for forced, usual in ((O.ocr_dedup(words, 0), O.ocr_dedup(words)), (O.ocr_page(words, 12), O.ocr_page(words)),
                          (O.iou_pairs(words, 0), O.iou_pairs(words)), (O.iou_links(words, 0), O.iou_links(words))):
        assert exchanges(forced) == 1 and rows(forced) == rows(usual)
    # Images of too many words go by bands, beside the others.
    more = words.unionByName(words.filter("image_id = 0 and seq < 50").withColumn("image_id", F.lit(9)))
    sizes = O.large_images(more, 0, image_limit=100)
    assert sizes.many.count() == 3
    assert rows(O.ocr_dedup(more, 0, sizes)) == rows(O.ocr_dedup(more))


def test_fractions_sort_no_words(spark):
    """Finding F18: the words of a task are not sorted for the join."""
    words = spark.createDataFrame([(0, 0, i, "w", 50.0, 9, 9, 20, 10) for i in range(20)] + [(5, 0, 0, "x", 50.0, 9, 9, 20, 10)], WORDS)
    out = O.ocr_fractions(words, spark.createDataFrame([(0, 90, 0)], "image_id bigint, width int, height int"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert {(r.image_id, r.left, r.top) for r in out.collect()} == {(0, 0.1, 9.0), (5, 9.0, 9.0)}


def test_reading_order_shuffles_words_once(spark):
    """Finding F20: words are dealt once even where the totals of blocks are not broadcast; positions go on over blocks."""
    words = spark.createDataFrame([(i % 3, 0, i, "w", 50.0 + i % 2, i % 7, i // 9, 20, 10) for i in range(400)], WORDS)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = O.reading_order(words, 4)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.image_id, r.seq): r.reading_pos for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    want = {}
    for image in range(3):
        mine = sorted((r for r in words.collect() if r.image_id == image), key=lambda r: (r.top_px, r.left_px, -r.confidence, r.seq))
        want |= {(image, r.seq): n for n, r in enumerate(mine, 1)}
    assert got == want and out.columns == [*words.columns, "reading_pos"]
