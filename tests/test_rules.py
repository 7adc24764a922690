"""Golden cases of the name, size and colour rules, and of the block-wise running totals."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import rules
from rasterloom.functions.rounding import one_decimal
from rasterloom.functions.scale import dimension_join, numbered, pos_block, running
from rasterloom.operators import catalog as C
from rasterloom.operators import intake as I
from rasterloom.operators import planning as P


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_names_and_labels(spark):
    name = F.lit("photo.large.png")
    assert values(spark, rules.rename_output(name, "resized", "webp")) == ("photo.large-resized.webp",)
    sizes = [rules.format_bytes(F.lit(n).cast("bigint")) for n in (900, 1023, 1024, 1280, 1536, 2097152)]
    assert values(spark, *sizes) == ("900 B", "1023 B", "1.0 KB", "1.3 KB", "1.5 KB", "2.00 MB")
    assert values(spark, *[rules.clamp_quality(q) for q in (5, 75, 120)]) == (0.1, 0.75, 1.0)
    assert values(spark, *rules.fit_max_side(F.lit(4000), F.lit(2000), 1000)) == (1000, 500)
    assert values(spark, *rules.fit_max_side(F.lit(800), F.lit(600), 1000)) == (800, 600)


def test_dedupe_names(spark):
    names = ["a.png", "a.png", "b.png", "raw", "raw", ".env", ".env", "a-2.png", "x.tar.gz", "x.tar.gz"]
    df = spark.createDataFrame([("z", i, n) for i, n in enumerate(names)], "album string, pos int, file_name string")
    want = ["a.png", "a-2.png", "b.png", "raw", "raw-2", ".env", "-2.env", "a-2.png", "x.tar.gz", "x.tar-2.gz"]
    for rows in (None, 1, 3):
        got = C.dedupe_names(df, rows_per_block=rows).orderBy("pos").select("unique_name").collect()
        assert [r[0] for r in got] == want


def test_hex_colors(spark):
    cases = {
        "#f00": (255, 0, 0), "#00ff10": (0, 255, 16), "1234ab": (0x12, 0x34, 0xAB), "#12zzzz": (0, 0, 0x12),
        "#zz": (255, 255, 255), "": (255, 255, 255), "#": (255, 255, 255), "#1z3": (0, 0, 0x11), "0x12": (0, 0, 0x12),
        "#11223344": (0x22, 0x33, 0x44),
    }
    df = spark.createDataFrame([(k,) for k in cases], "color string")
    assert {r.color: (r.red, r.green, r.blue) for r in C.parse_hex_color(df).collect()} == cases
    assert {text: rules.hex_value(text) for text in cases} == cases


def test_one_decimal(spark):
    rng = random.Random(2)
    numbers = [rng.randrange(0, 10001) / 100 for _ in range(3000)] + [rng.uniform(0, 100) for _ in range(500)]
    numbers += [96.25, 96.35, 0.05, 0.15, 0.25, 99.95, 30.0]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", one_decimal(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 1) for r in rows)
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),)], "v double").select(one_decimal(F.col("v")).alias("r")).collect()
    assert odd[0].r == float("inf") and odd[1].r != odd[1].r


def test_aspect(spark):
    k = rules.aspect_factor(F.lit(200), F.lit(100), F.lit(1), F.lit(1))
    assert values(spark, k, *rules.centred_crop(k)) == (2.0, 0.25, 0.0, 0.5, 1.0)


def test_language_codes(spark):
    df = spark.createDataFrame([("eng",), ("eng+fra",), ("eng\n",), ("en",), ("eng+",), ("eng\n\n",), (None,)], "lang string")
    assert [r.lang_ok for r in C.ocr_lang_check(df).collect()] == [True, True, True, False, False, False, False]


def test_validation_boundaries(spark):
    rows = [
        (1, "scale", {"percent": "200"}), (2, "scale", {"percent": "200.5"}), (3, "merge", {"files": "1"}),
        (4, "ocr", {"lang": ""}), (5, "ocr", {}), (6, "adjust", {"blur": "abc"}), (7, "margin", {"top": "-1", "opacity": "101"}),
    ]
    df = spark.createDataFrame(rows, "recipe_id int, tool_id string, params map<string,string>")
    got = {r.recipe_id: r.failed for r in C.validate_recipes(df).collect()}
    assert got == {1: [], 2: ["percent"], 3: ["files"], 4: ["lang"], 5: [], 6: ["blur"], 7: ["opacity", "top"]}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_blocks(spark, width):
    random.seed(width)
    rows = [(random.choice(["a", "b", None]), i, random.randint(0, 9)) for i in random.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    sums = running(df, ["k"], ["pos"], pos_block("pos", width), F.col("v"), "s")
    tops = running(df, ["k"], ["pos"], pos_block("pos", width), F.col("v"), "m", agg="max", inclusive=True)
    nth = numbered(df, ["k"], ["pos"], pos_block("pos", width), "n")
    got = {r.pos: (r.s, r.m, r.n) for r in sums.join(tops.select("pos", "m"), "pos").join(nth.select("pos", "n"), "pos").collect()}
    for key in ("a", "b", None):
        total, top = 0, None
        for n, (_, pos, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            top = v if top is None else max(top, v)
            assert got[pos] == (total, top, n)
            total += v


def test_dimension_join_large_side(spark):
    facts = spark.range(500).selectExpr("id", "'hot' as k")
    dim = spark.range(30).selectExpr("id as d", "if(id < 25, 'hot', 'cold') as k")
    one, other = (dimension_join(facts, dim, ["k"], F.col("id"), limit) for limit in (100, 5))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert one.count() == 500 * 25


def test_rendition_plan_without_broadcast(spark):
    images = spark.createDataFrame(
        [(i, "z", i, f"p{i}.png", "image/png" if i % 2 else "image/gif", 100 + i, 50, 9) for i in range(40)],
        "image_id bigint, album string, pos int, file_name string, mime string, width int, height int, size_bytes long")
    recipes = spark.createDataFrame([("r1", "scale", {}), ("r2", "margin", {"all": "3"}), ("r3", "merge", {})],
                                    "recipe_id string, tool_id string, params map<string,string>")
    a, b = (sorted(map(tuple, P.rendition_plan(images, recipes, None, n).collect()), key=str) for n in (1000, 0))
    assert a == b and len(a) == 41


@pytest.mark.parametrize("args,sizes,canvas,last", [
    (("vertical", "start", "none"), [(100, 40), (60, 30)], (100, 70), (0, 40)),
    (("vertical", "center", "none"), [(100, 40), (60, 30)], (100, 70), (20, 40)),
    (("vertical", "end", "none"), [(100, 40), (60, 30)], (100, 70), (40, 40)),
    (("vertical", "start", "fill"), [(100, 50), (50, 40)], (100, 130), (0, 50)),
    (("horizontal", "start", "fill"), [(50, 100), (40, 50)], (130, 100), (50, 0)),
])
def test_merge_layout(spark, args, sizes, canvas, last):
    df = spark.createDataFrame([("z", i, w, h) for i, (w, h) in enumerate(sizes)], "album string, pos int, width int, height int")
    for block in (1, 1000):
        r = P.merge_layout(df, *args, rows_per_block=block).orderBy("pos").collect()[-1]
        assert (r.canvas_width, r.canvas_height) == canvas and (r.place_x, r.place_y) == last
    assert P.merge_layout(df.limit(0), *args).count() == 0


def test_append_rules(spark):
    old = spark.createDataFrame([("z", 0, "a"), ("z", 1, "b")], "album string, pos int, file_name string")
    new = spark.createDataFrame([("z", 0, "c"), ("z", 1, "a")], "album string, pos int, file_name string")
    names = lambda df: [r.file_name for r in df.orderBy("list_pos").collect()]
    both = I.append_all([old, new, new.limit(0)])
    assert names(I.append_cap(both, None)) == ["a", "b", "c", "a"]
    assert names(I.append_cap(both, None, rows_per_block=1)) == ["a", "b", "c", "a"]
    assert names(I.append_cap(both, 3)) == ["a", "b", "c"]
    assert names(I.append_cap(both, 1)) == ["c"]
    assert names(I.append_cap(I.append_all([old]), 1)) == ["a"]


def test_batch_report(spark):
    rows = [("one", 0, "x.gif", "image/gif", 5)]
    rows += [("many", i, f"f{i}", "image/gif" if i < 5 else "image/png", 5) for i in range(9)]
    rows += [("two", 0, "a", "image/png", 0), ("two", 1, "b", "image/png", 1), ("fine", 0, "a", "image/png", 1)]
    df = spark.createDataFrame(rows, "album string, pos int, file_name string, mime string, size_bytes bigint")
    got = {r.album: r.report for r in P.batch_report(P.batch_run(df)).collect()}
    kind = "Unsupported image type. Use PNG, JPEG, or WebP."
    assert got == {
        "one": kind, "fine": "", "two": "1 of 2 images failed (a): Empty upload.",
        "many": f"5 of 9 images failed (f0, f1, f2 and 2 more): {kind}",
    }


def test_archive(spark):
    entries = spark.createDataFrame([("z", 0, "hello.txt", bytearray(b"hello")), ("z", 1, "é.txt", bytearray(b""))],
                                    "album string, pos int, unique_name string, content binary")
    rows = P.archive_entries(entries, rows_per_block=1).orderBy("pos").collect()
    assert rows[0].crc == 0x3610A686 and [r.header_offset for r in rows] == [0, 30 + 9 + 5]
    archives = spark.createDataFrame([("z",), ("empty",)], "album string")
    totals = {r.album: r.archive_bytes for r in P.archive_totals(P.archive_entries(entries), archives).collect()}
    assert totals == {"empty": 22, "z": (30 + 9 + 5) + (30 + 6) + (46 + 9) + (46 + 6) + 22}


def test_budget_search_any_sizes(spark):
    random.seed(5)
    ladders = {i: [random.randint(0, 100) for _ in range(128)] for i in range(40)}
    ladders[40] = [1000] * 128
    images = spark.createDataFrame([(i, "image/png" if i % 2 else "image/jpeg") for i in ladders], "image_id bigint, mime string")
    rungs = spark.createDataFrame([(i, k, v) for i, l in ladders.items() for k, v in enumerate(l)], "image_id bigint, k int, size_bytes bigint")
    got = {r.image_id: r.k for r in P.budget_search(images, rungs, F.lit(50)).collect()}
    for i, sizes in ladders.items():
        low, high, best = 0, 128, 0
        for _ in range(7):
            mid = (low + high) // 2
            low, high, best = (mid, high, mid) if sizes[mid] <= 50 else (low, mid, best)
        assert got[i] == best


def test_monotone_search_sorts_no_rungs(spark):
    """Finding F19: the rungs of a task are not sorted for the join with the budgets."""
    images = spark.createDataFrame([(i, 100 * i) for i in range(5)], "image_id bigint, size_bytes bigint")
    rungs = spark.createDataFrame([(i, k, 4 * k) for i in range(4) for k in range(128)], "image_id bigint, k int, size_bytes bigint")
    out = P.budget_search_monotone(images, rungs, F.col("size_bytes"))
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.image_id: r.k for r in out.collect()} == {0: 0, 1: 25, 2: 50, 3: 75, 4: None}
