"""Operators on vectors and the classifier against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import pivot_search, quality, rp_forest

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(420):
        x = centres[i % 12] + rng.standard_normal(16) * (0.12 if i % 3 else 1.0)
        rows.append((i, x.astype(np.float32).tolist(), i % 2))
    same = rows[5][1]
    rows += [(500 + i, same, 1) for i in range(30)] + [(600, same, None), (601, None, 1), (602, [0.0] * 16, 1), (603, [NAN] * 16, 1)]
    rows += [(604, [INF] + [1.0] * 15, 1), (605, [None] + [1.0] * 15, 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (608, [], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, tree int, node string").repartition(3)


def linked(rows):
    good = [(i, np.array(x, float), y) for i, x, y in rows if x and y is not None and None not in x and np.isfinite(x).all() and any(x)]
    return {i: [j for j, z, w in good if i != j and y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.93]
            for i, x, y in good}


@pytest.mark.parametrize("options", [{}, {"node": 60, "leaf": 12}])
def test_rp_forest(spark, vectors, options):
    got = {r["vec_id"]: r for r in rp_forest.near_duplicates(frame(spark, vectors), **options).collect()}
    links = linked(vectors)
    assert len(got) == len(vectors)
    total = sum(map(len, links.values()))
    assert total > 2000
    found = sum(r["n_links"] for r in got.values())
    assert found == total if not options else 0.99 * total <= found <= total
    for i in got:
        reached, front = {i}, [i]
        while front:
            front = [b for a in front for b in links.get(a, []) if b not in reached and not reached.add(b)]
        assert got[i]["component_id"] == min(reached) and got[i]["kept"] == (i == min(reached))


def test_rp_forest_repeats(spark, vectors):
    x = vectors[0][1]
    got = sorted(map(tuple, rp_forest.near_duplicates(frame(spark, [(1, x, 0), (1, x, 0), (2, x, 0), (None, x, 0)])).collect()), key=str)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]
    assert rp_forest.near_duplicates(frame(spark, vectors).filter("false")).isEmpty()


def test_pivot_search(spark, vectors, monkeypatch):
    for blocks in (None, 40):
        if blocks:
            monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 5)
            monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", blocks)
        got = sorted(map(tuple, pivot_search.search(frame(spark, vectors), F.col("vec_id") % 50 == 0).collect()))
        good = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x, _ in vectors if x is not None and None not in x and np.isfinite(x).all()]
        want = []
        for q, x in good:
            if q % 50 == 0:
                best = sorted(((-int(x @ z), j) for j, z in good if j != q and len(z) == len(x)))[:5]
                want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
        assert got == sorted(want)
    assert pivot_search.search(frame(spark, vectors).filter("false"), F.lit(True)).isEmpty()
    assert len(pivot_search.search(frame(spark, [(0, [1.0], 1), (1, [2.0], 1), (1, [2.0], 1), (None, [3.0], 1)]), F.lit(True)).collect()) == 2


def test_pivot_search_of_large_components(spark):
    """Products past 53 and 64 bits are exact, and end no search."""
    rng = np.random.default_rng(7)
    for scale in (1e5, 1e8, 1e13):
        rows = [(i, [float(v) for v in np.float32(rng.standard_normal(6) * scale)], 1) for i in range(60)]
        got = sorted(map(tuple, pivot_search.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()))
        whole = {i: [int(np.floor(256 * v)) for v in x] for i, x, _ in rows}
        want = []
        for q in (0, 20, 40):
            best = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:5]
            want += [(q, k + 1, i, min(-s, 2**63 - 1)) for k, (s, i) in enumerate(best)]
        assert got == sorted(want)


def test_pivots_eliminate():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((40, 8))[rng.integers(0, 40, 4000)] * 256 + rng.standard_normal((4000, 8))).astype(np.int64).astype(float)
    points = pivot_search.chosen_pivots(x[:200], 32)
    radius = float((x**2).sum(1).max())
    table = pivot_search.distances(x, np.sqrt(radius - (x**2).sum(1)), points)
    q = x[7]
    scores, ids, seen = pivot_search.best_of_block(q, pivot_search.distances(q[None], np.zeros(1), points)[0], x, table, np.arange(4000), 7, radius, 5)
    want = sorted(((-(x[i] @ q), i) for i in range(4000) if i != 7))[:5]
    assert list(zip(-scores, ids)) == want and seen < 4000


def test_quality(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("an", "the", "ne", "ro") for b in ("", "ning", "rest", "mol")]
    rows, labels = [], []
    for i in range(800):
        text = [words[j] for j in rng.integers(0, len(words), rng.integers(5, 120))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "&&&" for w in text) if bad and i % 2 else " ".join(text[:3] * 20) if bad else " ".join(text) + "."))
        labels.append((i, int(not bad)))
    rows += [(900, None), (901, ""), (902, "x" * 200_000), (None, "the rest")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    trees = quality.fit(docs, marks, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r for r in quality.quality(docs, trees).collect()}
    wrong = [i for i, y in labels if got[i]["predicted"] != y]
    assert len(got) == len(rows) and len(wrong) < 16
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = quality.fit(docs.repartition(5), marks, F.col("doc_id") % 3 != 0)
    assert np.array_equal(again.cut, trees.cut) and np.array_equal(again.value, trees.value)
    assert quality.quality(docs, quality.fit(docs, marks.filter("false"), F.lit(True))).count() == len(rows)


def test_trees_are_walked_like_rules():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.boosted(x, y, trees=30, depth=3)
    for row, score in zip(x[:50], trees.score(x[:50])):
        total = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            total += value[at - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert (((trees.score(x) > 0.5) == y).mean()) > 0.95
