"""Compact rows of words, and duplicates, lines and texts of whole images."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import ocr as O
from rasterloom.operators import pages, spots
from test_ocr import WORDS, check_page, exchanges, page_words
from test_ocr import pages as random_pages

rows = lambda df: sorted(map(tuple, df.collect()), key=str)


def table(image, n, seed, text=lambda i: f"w{i}"):
    rng = random.Random(seed)
    return pa.table({
        "image_id": pa.array([image] * n, pa.string()), "pass": pa.array([rng.choice([0, 1, None]) for _ in range(n)], pa.int32()),
        "seq": pa.array([rng.randrange(-5, 9) for _ in range(n)], pa.int32()), "text": pa.array([text(i) for i in range(n)], pa.string()),
        "confidence": [rng.choice([30.0, 96.2, 1 / 3, -0.0, None, float("inf")]) for _ in range(n)],
        **{c: pa.array([rng.choice([0, 7, -2**31, 2**31 - 1, None, rng.randrange(9)]) for _ in range(n)], pa.int32()) for c in O.BOX}})


def test_compact_rows_hold_the_same_words():
    """Finding F1: any words come back from their compact rows, wherever the words of an image lie."""
    parts = [table("a", 5, 1), table(None, 1, 2, lambda i: None), table("b", 900, 3, lambda i: "" if i % 3 else "é世"), table("a", 40, 4)]
    want = pa.concat_tables(parts)
    for size in (1, 7, 10_000):
        compact = list(pages.pack(iter(want.to_batches(max_chunksize=size)), 50))
        assert sum(b.column("n").to_pylist()[i] for b in compact for i in range(b.num_rows)) == 946
        ids = pa.concat_arrays([b.column("image_id") for b in compact])
        words = pages.unpacked(ids, np.concatenate([b.column("n").to_numpy() for b in compact]).astype(np.int64), [x for b in compact for x in b.column("blob").to_pylist()])
        got = pa.table(words.columns(want.column_names, [f.type for f in want.schema]), want.column_names)
        assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist()))
        image = got.column("image_id").to_pylist()
        assert sum(a != b for a, b in zip(image, image[1:])) == 2


@pytest.mark.parametrize("spread,most", [(400, 64), (25, 64), (25, 0)])
def test_kept_words_are_those_of_the_fold(monkeypatch, spread, most):
    """Finding F5: pairs settled from the most certain word on, and the index of kept words, give the rows of a plain fold."""
    monkeypatch.setattr(spots.similar_once, "__defaults__", (most, *spots.similar_once.__defaults__[1:]))
    rng = random.Random(spread)
    n = 2500
    box = lambda: (rng.randrange(-spread, spread), rng.randrange(spread), rng.choice([0, 5, 17, 40]), rng.choice([0, 9, 16]))
    boxes = np.array([box() for _ in range(n)], np.int64).T
    image, certain = np.sort(np.array([rng.randrange(3) for _ in range(n)])), np.array([float(rng.randrange(30, 40)) for _ in range(n)])
    words = pages.Words(pa.array([5, 6, 7]), image, [np.zeros(n, np.int64), np.arange(n), *boxes], certain, pa.array(["t"] * n), np.zeros(n, np.int64))
    order = np.lexsort((np.arange(n), -certain, image))
    want = order[spots.kept_places(image[order], [b[order] for b in boxes])]
    assert sorted(pages.kept(words).tolist()) == sorted(want.tolist())


def test_whole_images_are_not_shuffled(spark):
    """Findings F1, F5: where an image's words lie in one part, they stay there; others meet, with the same result."""
    words = page_words(spark, 4)
    whole = words.coalesce(1).sortWithinPartitions("image_id")
    scattered = words.repartition(8, "seq")
    for make in (lambda w: O.ocr_page(w, 12), lambda w: O.ocr_dedup(w, 0)):
        assert exchanges(make(whole)) == 0 and exchanges(make(scattered)) == 1
        assert rows(make(whole)) == rows(make(scattered)) and len(rows(make(whole))) > 100


def test_images_of_too_many_words_go_by_bands(spark):
    words = page_words(spark, 4)
    parts = O.gathered(words, image_limit=60)
    assert parts.many is not None and parts.many.select("image_id").distinct().count() == parts.sizes.many.count() > 0
    assert rows(O.ocr_page(parts)) == rows(O.ocr_page(words)) and rows(O.ocr_text(parts)) == rows(O.ocr_text(words))
    assert rows(O.ocr_lines(O.ocr_dedup(parts), sizes=parts.sizes)) == rows(O.ocr_page(words))


def test_images_without_an_id_meet(spark):
    words = page_words(spark, 4).withColumn("image_id", F.when(F.col("image_id") != 0, F.col("image_id"))).repartition(5, "seq")
    other = words.withColumn("image_id", F.coalesce("image_id", F.lit(99)))
    got = rows(O.ocr_page(words).withColumn("image_id", F.coalesce("image_id", F.lit(99))))
    assert got == rows(O.ocr_page(other)) and any(r[0] == 99 for r in got)


def test_streamed_lines_of_whole_images_are_not_shuffled(spark):
    """Finding F2: words are packed once for duplicates and lines, and stay where they are."""
    words = O.gathered(page_words(spark, 5).coalesce(1).sortWithinPartitions("image_id"))
    kept = O.ocr_dedup(words)
    streamed = O.ocr_lines(kept, 0, words.sizes)
    assert exchanges(streamed) == 0 and rows(streamed) == rows(O.ocr_page(page_words(spark, 5)))
    # A table that is not as duplicate removal left it is packed again.
    assert rows(O.ocr_lines(kept.repartition(5, "seq"), 0, words.sizes)) == rows(streamed)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_texts_of_whole_images(spark, limit):
    """Finding F6: texts are made in one pass over whole images, without a shuffle where these lie in one part; odd pages, too."""
    data = random_pages(7)
    words = spark.createDataFrame([(i, p, s, t, c, l, tp, w, h) for i, ws in data.items() for c, (p, s), l, tp, w, h, t in ws], WORDS)
    texts, page = O.ocr_text(words.coalesce(1).sortWithinPartitions("image_id"), limit), O.ocr_page(words, limit)
    assert exchanges(texts) == 0 and rows(texts) == rows(O.page_text(page))
    lined, found = page.collect(), {r.image_id: r.text for r in texts.collect()}
    for image, ws in data.items():
        ranked = {w[1]: (w[2:6], w[6]) for w in sorted(ws, key=lambda w: (-w[0], w[1]))}
        check_page(ranked, {(r["pass"], r.seq): r.line for r in lined if r.image_id == image}, found.get(image, ""))


def test_result_gathers_compact_rows(spark):
    """Finding F4: the words of a page are not shuffled one by one; images with several rows of sizes, or without words, stay as they were."""
    words = page_words(spark, 4)
    sizes = [(0, "a", 300, 100), (1, "b", 0, 7), (1, "b", 50, None), (2, "c", 9, 9), (3, None, 4, 4), (4, "e", None, 5), (77, "f", 1, 1), (None, "g", 1, 1)]
    images = spark.createDataFrame(sizes, "image_id bigint, file_name string, width int, height int")
    page = O.ocr_page(words.coalesce(1).sortWithinPartitions("image_id"))
    plan = O.ocr_result(images, page)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "confidence" in line for line in plan.split("\n")) and "ShuffledHashJoin" not in plan
    plain = O.ocr_result(images, page.filter("seq >= 0"))
    assert O.ocr_result(images, page).schema.simpleString() == plain.schema.simpleString()
    got = rows(O.ocr_result(images, page))
    assert got == rows(plain) and len(got) == len(sizes) and sum(len(r[5]) for r in got) > 100
