"""Vector codes, phrases and sharding against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.ship import ship_package
from rasterloom.llm import phrases, sharding, vector_codes


# --- vector codes -----------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """Lloyd's rounds in Python integers over {vec_id: integer vector}."""
    width = len(next(iter(rows.values()))) // parts
    cut = {i: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for i, v in rows.items()}
    books = [[cut[i][p] for i in sorted(rows)[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda e: (dist(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut.values():
                groups[near(v[p], books[p])].append(v[p])
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else books[p][e] for e in range(len(books[p]))]
    codes = {i: [near(v[p], books[p]) for p in range(parts)] for i, v in cut.items()}
    errors = {i: sum(dist(cut[i][p], books[p][codes[i][p]]) for p in range(parts)) for i in rows}
    text = ",".join(str(x) for b in books for e in b for x in e)
    return codes, errors, hashlib.sha256(text.encode()).hexdigest()


def vectors(n, seed, spread=1.0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    return [(i * 3, (centres[i % 9] + rng.standard_normal(dim) * spread).astype(np.float32).tolist(), i % 4 if i % 5 else None) for i in range(n)]


def vector_frame(spark, rows, parts=4):
    ship_package(spark)
    return spark.createDataFrame([(*r, 7, "c") for r in rows], "vec_id long, embedding array<float>, label int, code int, error string").repartition(parts)


@pytest.mark.parametrize("spread,chunk", [(1.0, 4096), (0.05, 128), (0.05, 1)])
def test_vector_codes(spark, spread, chunk):
    rows = vectors(500, 3, spread)
    rows += [(5001 + i, rows[7][1], 1) for i in range(150)]  # copies
    odd = [(9000, None, 1), (9001, [float("nan")] * 16, 1), (9002, [None] + [1.0] * 15, 1), (9003, [float("inf")] * 16, 2), (9004, [1.0] * 8, 1),
           (9005, [], 1), (None, [1.0] * 16, 1)]
    if chunk == 1:
        rows = rows[:120]
    got = {r["vec_id"]: r for r in vector_codes.report(vector_frame(spark, rows + odd), parts=4, entries=20, chunk=chunk).collect()}
    ints = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v, _ in rows}
    codes, errors, digest = plain_codes(ints, 4, 20, 2)
    assert {i: r["code"] for i, r in got.items()} == {i: "".join(f"{c:02x}" for c in code) for i, code in codes.items()}
    assert {i: r["error"] for i, r in got.items()} == errors
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}
    of = defaultdict(int)
    for i, _, label in rows:
        of[label] += errors[i]
    assert all(got[i]["label_error"] == of[label] for i, _, label in rows)


def test_large_components_and_few_vectors(spark):
    rows = [(i, [float((i * 7919 + j * j * 31) % 1000) * 10.0 ** (j % 9) for j in range(16)], 0) for i in range(60)]
    got = {r["vec_id"]: r for r in vector_codes.report(vector_frame(spark, rows), parts=4, entries=8).collect()}
    ints = {i: [int(np.float64(np.float32(x)) * 256) for x in v] for i, v, _ in rows}
    codes, errors, digest = plain_codes(ints, 4, 8, 2)
    assert {i: r["code"] for i, r in got.items()} == {i: "".join(f"{c:02x}" for c in code) for i, code in codes.items()}
    assert {i: r["error"] for i, r in got.items()} == {i: min(e, 2**63 - 1) for i, e in errors.items()}
    assert got[0]["codebooks_sha256"] == digest
    few = vector_codes.report(vector_frame(spark, rows[:3]), parts=4, entries=8).collect()
    assert sorted(r["code"] for r in few) == ["00" * 4, "01" * 4, "02" * 4] and all(r["error"] == 0 for r in few)
    assert vector_codes.report(vector_frame(spark, rows).filter("false")).isEmpty()
    # rows that repeat a vector, number included, are one vector
    assert vector_codes.report(vector_frame(spark, [rows[0], rows[0], rows[1]]), parts=4).count() == 2


def test_cover_trees():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.round(rng.standard_normal((700, 3)) * 40), np.zeros((90, 3)), np.round(rng.standard_normal((300, 3)))])
    roots = np.array([0, 790, 790, 1090])
    order, nodes, radius = vector_codes.cover_trees(x, roots, leaf=8)
    assert sorted(order[:790]) == list(range(790)) and sorted(order[790:]) == list(range(790, 1090))
    points = x[order]
    for (lo, hi, child, kids), r in zip(nodes, radius):
        far = np.sqrt(((points[lo:hi] - points[lo]) ** 2).sum(1)).max()
        assert far <= r <= far * (1 + 1e-6) + 1e-12
        below = nodes[child : child + kids] if kids else []
        if len(below):
            assert below[0][0] == lo and below[-1][1] == hi and all(a[1] == b[0] for a, b in zip(below, below[1:]))
            centres = points[[b[0] for b in below]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e9
            assert kids >= 2 and apart.min() > r / 2 * (1 - 1e-6)
        else:
            assert hi - lo <= 8 or far == 0


def test_triangle_inequality_settles_whole_subtrees():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (32, 8))
    x = (centres[rng.integers(0, 32, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(float)
    chunk = vector_codes.Chunk(x, 2)
    books = np.array([[[int(v) for v in c[p * 4 : p * 4 + 4]] for c in centres] for p in range(2)], object)
    entry, compared = chunk.assign(books)
    assert compared < 0.1 * 8000
    for p in range(2):
        want = vector_codes.squares(chunk.points[p * 4000 : (p + 1) * 4000], books[p].astype(float)).argmin(1)
        assert (entry[p * 4000 : (p + 1) * 4000] == want).all()


def test_decode():
    books = np.arange(2 * 3 * 2).reshape(2, 3, 2)
    assert vector_codes.decode("0201", books) == [4, 5, 8, 9]


# --- phrases ------------------------------------------------------------------------------------------


def plain_phrases(rows, least=10, top=2000):
    grams, out = defaultdict(Counter), []
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    grams[lang or "und"][tuple(w[i : i + k])] += 1
    for lang, f in grams.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        good = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in good.items():
            if len(g) == 2 and any(g in (h[:2], h[1:]) and 100 * c >= 50 * a for h, c in good.items() if len(h) == 3):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return out


def texts_for_phrases():
    rng = np.random.default_rng(8)
    words = ["Alpha", "beta", "BETA", "gämma", "delta\x1c", "é", "\x00", "ÿ", "new", "york", "city", "of"]
    rows = []
    for i in range(160):
        parts = rng.choice(words, rng.integers(0, 60))
        text = "".join(w + str(rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", ";x:", "!?", " "])) for w in parts)
        rows.append((["en", None, "und", "de"][i % 4], text + " New York City" * int(rng.integers(0, 3))))
    long = " ".join(rng.choice(words[:4], 4000)) + "." + "same words " * 700
    return rows + [("en", long), ("fr", "one two " * 40), ("fr", None), ("xx", ""), (None, None), *[("de", "copy of a line. " * 3)] * 30]


@pytest.mark.parametrize("sizes", [{}, {"block_words": 90, "held": 50, "range_": 16, "cut_bits": 2}])
def test_phrases(spark, sizes, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 500)
    ship_package(spark)
    rows = texts_for_phrases()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, rank int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in phrases.report(df, **sizes).collect())
    want = sorted(plain_phrases(rows))
    assert got == want and len(got) > 60
    top = phrases.report(df, top=3, **sizes).collect()
    assert sorted(tuple(r) for r in top) == sorted(plain_phrases(rows, top=3))
    assert phrases.report(df.filter("false"), **sizes).isEmpty()


@pytest.mark.parametrize("bits", [2, 3, 9, 20, 21, 22, 30, 42])
def test_packing_loses_nothing(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(1, 1 << bits, 3000) for _ in range(3)]
    pack = phrases.Packing(bits)
    high, low = pack.scramble(ids)
    assert all((a == b).all() for a, b in zip(pack.restore(high, low), ids))
    assert (pack.restore(*pack.scramble(ids[:2]))[2] == 0).all()
    keys = phrases.counted(high, low, None, pack.half)
    again = Counter(zip(high.tolist(), low.tolist()))
    assert {(h, l): n for h, l, n in zip(*(k.tolist() for k in keys))} == again
    for fixed in (0, min(4, pack.half)):
        found = Counter()
        counts = keys[2] + np.where(np.arange(len(keys[2])) % 50 == 0, 10_000_000_000, 0)
        for batch in phrases._filters(3, keys[0], keys[1], counts, pack.half, fixed):
            for row in batch.to_pylist():
                for h, l, n in zip(*(x.tolist() for x in phrases.open_filter(row, row["shard"], pack.half))):
                    found[h, l] += n
        assert found == Counter({(h, l): n for h, l, n in zip(keys[0].tolist(), keys[1].tolist(), counts.tolist())})


# --- sharding -----------------------------------------------------------------------------------------


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, shard string, row int").repartition(6)


def checked_shards(rows, got, shards=8):
    assert len(got) == len(rows)
    sizes = {s: [] for s in range(shards)}
    for r in got:
        sizes[r["shard"]].append((r["slot"], r["size"]))
    for held in sizes.values():
        assert sorted(s for s, _ in held) == list(range(len(held)))
    loads = [sum(n for _, n in held) for held in sizes.values()]
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / shards + 2 * min(max(r["size"] for r in got), 64), loads
    return loads


def test_sharding(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"own text {i} " * int(rng.integers(1, 12)), ) for i in range(1500)]
    rows += [(5000 + i, "hot copy " * 6) for i in range(900)]
    rows += [(7000 + i, f"pair {i // 2} " * 5) for i in range(400)]
    rows += [(None, "no number"), (None, "no number"), (9, "repeated id"), (9, None), (10000, None), (10001, ""), (10002, "long " * 400)]
    df = doc_frame(spark, rows)
    got = sharding.report(df).collect()
    checked_shards(rows, got)
    of = {i: t for i, t in rows}
    assert all(r["text_crc32"] == zlib.crc32((of[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] not in (None, 9))
    assert all(r["size"] == len((of[r["doc_id"]] or "").encode()) + 1 for r in got if r["doc_id"] not in (None, 9))
    shard = {r["doc_id"]: r["shard"] for r in got}
    # Pairs stay whole, the hot group fills as few shards as its size asks for, or one more.
    assert all(shard[7000 + 2 * i] == shard[7001 + 2 * i] for i in range(200))
    hot = Counter(shard[5000 + i] for i in range(900))
    share = sum(r["size"] for r in got) / 8
    assert len(hot) <= -(-900 * 55 // share) + 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    named = df.filter("doc_id is not null and doc_id <> 9")
    one, other = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.report(f).collect()) for f in (named, named.repartition(3)))
    assert one == other


def test_sharding_by_links(spark):
    """Communities that share keys: far fewer links are cut than by hashing, and sizes stay even."""
    rng = np.random.default_rng(6)
    rows = [(i, f"text number {i:05d}") for i in range(1600)]
    links = [(i, f"c{i % 40}-{rng.integers(0, 3)}") for i in range(1600) for _ in range(2)] + [(i, "all") for i in range(0, 1600, 40)]
    df = doc_frame(spark, rows)
    named = spark.createDataFrame([*links, (None, "x"), (3, None)], "doc_id long, key string")
    got = sharding.assign(df, 4, named).collect()
    checked_shards(rows, got, 4)
    of = {r["doc_id"]: r["shard"] for r in got}
    keys = defaultdict(set)
    for i, k in links:
        keys[k].add(i)
    cut = lambda place: sum(place(a) != place(b) for g in keys.values() for a, b in itertools.combinations(g, 2))
    assert cut(of.get) < 0.6 * cut(lambda i: hash((i, 1)) % 4)


def test_sharding_keeps_columns_and_empty_tables(spark):
    df = doc_frame(spark, [(i, f"t{i}") for i in range(20)])
    out = sharding.sharded(df, 3)
    assert out.columns == [*df.columns, "shard_1", "slot"] and out.count() == 20
    assert sharding.report(df.filter("false")).isEmpty()
    assert {r["shard"] for r in sharding.report(df.limit(2)).collect()} <= set(range(8))


def test_allowed_flows_respect_quotas():
    demand = {(0, 1): 100, (1, 0): 40, (2, 1): 60}
    flow = sharding.allowed(demand, [100, 90, 80], 100.0)
    load = [100 - flow[0, 1] + flow[1, 0], 90 + flow[0, 1] + flow[2, 1] - flow[1, 0], 80 - flow[2, 1]]
    assert all(v <= 100.5 for v in load) and all(0 <= flow[k] <= demand[k] for k in demand) and sum(flow.values()) > 85


def test_cut_counts_pairs(spark):
    told = sharding.facts(doc_frame(spark, [(i, "same") for i in range(30)]), 3)
    members = sharding.memberships(told, None)
    row = sharding.cut(members, told).first()
    inside = Counter(r["shard"] for r in told.collect())
    assert int(row["links"]) == 435 and int(row["cut_links"]) == 435 - sum(n * (n - 1) // 2 for n in inside.values())
    assert told.agg(F.max("shard")).first()[0] < 3
