"""Batches whose tool fails on some files, measured ladders, plans of mixed grain, plug-in forms."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rasterloom.operators import planning as P
from rasterloom.operators import plugins, runner
from rasterloom.operators import tools as T
from rasterloom.sources import exif as reader

# The workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = "image_id bigint, album string, pos int, file_name string, mime string, size_bytes bigint, content binary"


def halves():
    """Kernel: the first half of a file; fails in three ways."""
    def run(file):
        data = bytes(file["content"])
        if data == b"known":
            raise runner.ToolError("A known trouble.")
        if data == b"silent":
            raise runner.ToolError
        if data == b"crash":
            return {"half": 1 // 0}
        return {"half": data[: len(data) // 2], "n": len(data)}

    return run


def files(spark):
    bodies = [b"abcdef", b"known", None, b"crash", b"silent", b"", b"zz" * 5000, b"known", b"x"]
    rows = [(i, "hot" if i < 7 else "b", i, f"f{i}.png", "image/gif" if i == 8 else "image/png", 5, body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, FILES).repartition(3)


def test_batch_keeps_the_others(spark):
    run = P.batch_run(files(spark), None, halves, "half binary, n int", "It went wrong.")
    got = run.orderBy("pos").collect()
    assert "content" not in run.columns and len(got) == 9
    assert [r["message"] for r in got] == [
        None, "A known trouble.", "It went wrong.", "It went wrong.", "It went wrong.", None, None, "A known trouble.",
        "Unsupported image type. Use PNG, JPEG, or WebP."]
    assert all(r["ok"] == (r["message"] is None) for r in got)
    assert bytes(got[0]["half"]) == b"abc" and got[0]["n"] == 6 and got[1]["half"] is None and bytes(got[5]["half"]) == b""
    made, failed = runner.settle(run, ["half", "n"])
    assert sorted(r["pos"] for r in made.collect()) == [0, 5, 6] and "message" not in made.columns
    assert sorted(r["pos"] for r in failed.collect()) == [1, 2, 3, 4, 7, 8] and "half" not in failed.columns
    report = {r["album"]: r["report"] for r in P.batch_report(run).collect()}
    assert report["hot"] == "4 of 7 images failed (f1.png, f2.png, f3.png and 1 more): A known trouble."
    assert P.batch_run(files(spark).filter("false"), None, halves, "half binary, n int").isEmpty()


def test_attempt_names_and_shares(spark):
    with pytest.raises(ValueError):
        runner.attempt(files(spark), halves, "pos int", "no", ["content"])
    shares = runner.in_byte_shares(files(spark), F.octet_length("content"), share=500)
    assert shares.rdd.getNumPartitions() >= 20 and shares.count() == 9


def test_metadata_removal():
    app1, scan = b"\xff\xe1\x00\x06abcd", b"\xff\xda\x00\x04xx\xff\x00\xffdata"
    table = b"\xff\xdb\x00\x05abc"
    assert reader.without_metadata(b"\xff\xd8" + app1 + table + b"\xff\xfe\x00\x03c" + scan + b"\xff\xd9") == b"\xff\xd8" + table + scan + b"\xff\xd9"
    assert reader.without_metadata(b"\xff\xd8" + app1 + b"\xff\xd9") == b"\xff\xd8\xff\xd9"
    for bad in (b"", b"GIF", b"\xff\xd8", b"\xff\xd8" + app1[:-1], b"\xff\xd8" + scan, b"\xff\xd8\xff\xe1\x00\x01", b"\xff\xd8\xff\xe1\x00"):
        with pytest.raises(ValueError):
            reader.without_metadata(bad)


def plain_search(sizes, budget):
    low, high, best = 0, 128, None
    for _ in range(7):
        mid = (low + high) // 2
        if sizes[mid] <= budget:
            low = best = mid
        else:
            high = mid
    return low, sizes[low] <= budget


def test_target_settings_replay_the_search(spark):
    rng = random.Random(3)
    ladders = {i: [rng.randrange(1000) if i % 2 else k * 8 + rng.randrange(3) for k in range(128)] for i in range(25)}
    ladders[25], ladders[26] = [10**6] * 128, [0] * 128
    rungs = spark.createDataFrame([(i, k, s) for i, l in ladders.items() for k, s in enumerate(l)] + [(3, 400, 0), (3, None, 0)], "image_id long, k int, size_bytes long")
    wanted = spark.createDataFrame([(i, r, b) for i in [*ladders, 99] for r, b in (("a", 300), ("b", 700))], "image_id long, recipe_id string, budget long")
    got = {(r["image_id"], r["recipe_id"]): (r["bit"], r["met"]) for r in P.target_settings(wanted, rungs).collect()}
    assert got == {(i, r): plain_search(l, b) for i, l in ladders.items() for r, b in (("a", 300), ("b", 700))}


IMAGES = "image_id bigint, album string, pos int, file_name string, mime string, width int, height int, size_bytes long"
RECIPES = "recipe_id string, tool_id string, params map<string,string>"


def test_plan_of_mixed_grain(spark):
    images = spark.createDataFrame([
        (1, "two", 0, "a.png", "image/png", 400, 200, 5), (2, "two", 1, "b.jpg", "image/jpeg", 100, 100, 5), (3, "one", 0, "c.webp", "image/webp", 7, 9, 5),
        (4, "none", 0, "d.gif", "image/gif", 7, 9, 5), (5, None, 0, "e.png", "image/png", 30, 10, 5)], IMAGES)
    recipes = spark.createDataFrame([
        ("m", "merge", {}), ("f", "merge", {"direction": "horizontal", "resize": "fill"}), ("t", "compress", {"mode": "target", "targetKb": "10"}),
        ("bad", "scale", {"percent": "500"}), ("what", "nothing", {}), ("null", None, None)], RECIPES)
    rungs = spark.createDataFrame([(i, k, 80 * (k + 1)) for i in (1, 2) for k in range(128)], "image_id long, k int, size_bytes long")
    rows = P.rendition_plan(images, recipes, rungs).collect()
    album = {(r["album"], r["recipe_id"]): (r["out_width"], r["out_height"], r["reason"]) for r in rows if r["grain"] == "album"}
    assert album == {("two", "m"): (400, 300, None), ("two", "f"): (600, 200, None), ("one", "m"): (None, None, "too_few_files"), ("one", "f"): (None, None, "too_few_files")}
    image = {r["image_id"]: r for r in rows if r["grain"] == "image"}
    assert set(image) == {1, 2, 3, 5} and image[3]["reason"] == image[5]["reason"] == "not_measured" and image[5]["out_width"] is None
    # 127 rungs fit into 10240 bytes: the search ends at the last one
    assert (image[1]["knob"], image[1]["out_width"], image[1]["fits"]) == ("scale", round(400 * (0.05 + 0.95 * 127 / 128)), True)
    assert (image[2]["knob"], image[2]["out_width"]) == ("quality", 100) and abs(image[2]["setting"] - (0.05 + 0.9 * 127 / 128)) < 1e-12
    recipe = {r["recipe_id"]: (r["reason"], r["failed"]) for r in rows if r["grain"] == "recipe"}
    assert recipe == {"bad": ("invalid_settings", "percent"), "what": ("unknown_tool", None), "null": ("unknown_tool", None)}
    assert P.rendition_plan(images.filter("false"), recipes.filter("false"), rungs).isEmpty()


def test_plugin_forms_mix(spark):
    plugins.register_all()
    plugins.register_all()
    rows = [(i, y, x, 250 - 30 * x, 10 * y, 5, 255) for i in range(3) for y in range(5) for x in range(8)]
    px = spark.createDataFrame(rows, "image_id bigint, y int, x int, r int, g int, b int, a int").repartition(4)
    out = T.chain_tools(px, ("tone", {"strength": 1}), ("mask", {"level": 40}))
    square = lambda v: (v * v + 127) // 255
    want = {(i, y, x): 255 if (299 * square(r) + 587 * square(g) + 114 * square(b)) // 1000 >= 40 else 0 for i, y, x, r, g, b, _ in rows}
    assert {(r["image_id"], r["y"], r["x"]): r["mask"] for r in out.collect()} == want
    strips = T.apply_tool(out, "strips", height=2).collect()
    assert sorted(map(tuple, strips)) == sorted(
        (i, s, sum(v == 255 for (j, y, _), v in want.items() if j == i and y // 2 == s)) for i in range(3) for s in range(3))
    with pytest.raises(ValueError):
        T.register_kernel("tone", plugins.tone_curve, "r int")
    assert {"tone", "mask", "strips", "sepia"} <= set(T.registered())
