"""Operators on texts against brute force, on small tables with hard rows."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, jaccard_join, line_dedup, mixing, segmentation, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, h1 string, part string, first string"


def frame(spark, rows):
    """A table of documents with columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, None, s, None if t is None else len(t), 7, "x", None, "y") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", "<|im_end|>"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 160))) for _ in range(30)]
    passage = " ".join(f"p{i}" for i in range(60))
    line = "A line that very many of the documents share, word for word"
    out = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(base)]
    for i in range(30, 60):
        words_ = base[i % 30].split()
        at = rng.randrange(len(words_))
        words_[at] = "changed"
        out.append((i, " ".join(words_), "s1"))
    out += [(60, base[3], "s2"), (61, base[3], "s2"), (62, None, "s0"), (63, "", None), (64, " \n\t ", "s1"), (65, "\n\n", "s1")]
    out += [(66 + i, f"{base[i]} {passage} {base[i + 1]}\n  {line.upper()} \n{line}\nshort", "s1") for i in range(7)]
    out += [(80, "again " * 70, "s0"), (81, "again " * 45 + "other", "s0"), (82, " ".join(words * 30), "s0"), (83, "one two", "s4"), (84, "one two", "s4")]
    out += [(85, passage[: len(passage) // 2], "s1"), (86, " ".join(f"p{i}" for i in range(20, 50)), "s1")]
    return out


def test_toxic_hits_by_plain_scan():
    """Every entry of a folded text that no exception covers, found by looking at all places."""
    rng = random.Random(11)
    parts = ["bad", "ba", "word", "words", "is", "not", "at", "all", "badly", "b"]
    model = toxicity.Model({"bad": (2.0, 1), "word": (1.0, 64), "b": (0.5, 1), "at": (3.0, 1)}, ["not bad", "bad at all", "at"])
    automaton = model.automaton()
    for _ in range(400):
        words = [rng.choice(parts) for _ in range(rng.randrange(14))]
        text = f" {' '.join(words)} "
        starts = [m.start() + 1 for m in re.finditer(" (?=[^ ])", text)]
        hidden = [(s, s + len(e)) for e in model.exceptions for s in starts if text[s:].startswith(e + " ")]
        want = []
        for s in starts:
            word = text[s : text.index(" ", s)]
            for entry, (weight, rest) in model.lexicon.items():
                end = s + len(entry)
                if word.startswith(entry) and len(word) - len(entry) <= rest and not any(a <= s and end <= b for a, b in hidden):
                    want.append((s, weight))
        assert sorted((f, w) for f, _, w in toxicity.hits(automaton, text)) == sorted(want)


def test_toxic_hits_of_long_texts():
    """Many entries among many exceptions take no square of time."""
    model = toxicity.Model({"bad": (2.0, 1)}, ["not bad"])
    began = time.time()
    assert len(toxicity.hits(model.automaton(), " " + "not bad bad " * 60_000)) == 60_000 and time.time() - began < 5


def test_chat_slices_change_no_id():
    template, rng = chat.Template(), random.Random(2)
    parts = ["a", "B", "é", "日", " ", "  ", "\n", "\t", "1", "23", ".", "!?", "'s", "'re", " x", "\u00a0", "\u3000", "ǅ", "ʰ", " é", "\n b"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        for size in (1, 4):
            assert [i for p in chat.slices(text, size) for i in template.coder.encode_ordinary(p)] == template.segment(text)
    long = "word " * 9000 + "x" * 30_000 + " y, z" * 3000
    assert template.segment(long) == template.coder.encode_ordinary(long)


def test_chat_roles_come_back(spark):
    roles = ["user", "a\nb", "back\\slash\\n", "<|im_end|>\n", "\\", None, ""]
    df = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.assemble(chat.format_turns(df))).first()
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\nt{i}\n" for i, r in enumerate(roles)).encode()).hexdigest()


def test_substring_dedup(spark, rows):
    got = {r["doc_id"]: tuple(r) for r in substring_dedup.substring_report(frame(spark, rows)).collect()}
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    seen = set()
    for doc, text, _ in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        assert got[doc] == (doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest())
        assert texts[doc] == (kept.decode() if sum(gone) else text)
    assert got[80][2] > 0 and got[86][2] == 30


def test_substring_parts_and_small_automata(spark, rows, monkeypatch):
    """Split shards and automata of few windows give the same."""
    want = sorted(map(tuple, substring_dedup.substring_report(frame(spark, rows)).collect()))
    monkeypatch.setattr(substring_dedup, "PART_ANCHORS", 4)
    assert sorted(map(tuple, substring_dedup.substring_report(frame(spark, rows)).collect())) == want


def test_substring_ranges_and_few_words(spark, rows, monkeypatch):
    """Keys that go on over batches and ranges, and passages of more words than an automaton takes, give the same."""
    want = sorted(map(tuple, substring_dedup.substring_report(frame(spark, rows)).collect()))
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", 25)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for n in ("1", "7"):
            spark.conf.set(batch, n)
            assert sorted(map(tuple, substring_dedup.substring_report(frame(spark, rows)).collect())) == want
    finally:
        spark.conf.set(batch, before)


def test_range_summaries():
    """Any cut of sorted rows into ranges and batches settles to the same rows."""
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 40)
        data = sorted((rng.choice((0, 1, 5, rng.randrange(30))), rng.randrange(6), i) for i in range(n))
        want = {r: min(x[1:] for x in data if x[0] == r[0]) for r in data if sum(x[0] == r[0] for x in data) > 1}
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randrange(4)))})
        columns, seen = ["k", "doc_id", "pos", "first", "first_pos", "open", "n"], []
        for a, b in zip(cuts, cuts[1:]):
            part, at, batches = data[a:b], 0, []
            while at < len(part):
                size = rng.randrange(1, 6)
                some = list(zip(*part[at : at + size]))
                batches.append(pa.RecordBatch.from_pydict({"k": pa.array(some[0], pa.int64()), "doc_id": pa.array(some[1], pa.int64()), "pos": pa.array(some[2], pa.int32())}))
                at += size
            seen += [r for out in substring_dedup._recurring(["k"], columns)(iter(batches)) for r in out.to_pylist()]
        edges = {}
        for r in seen:
            if r["n"] is not None:
                at, m = edges.get((r["k"],), ((1 << 60, 0), 0))
                edges[(r["k"],)] = (min(at, (r["doc_id"], r["pos"])), m + r["n"])
        edges = {k: (*at, m) for k, (at, m) in edges.items()}
        rows, got = [r for r in seen if r["n"] is None], {}
        if rows:
            kinds = (("k", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("first", pa.int64()), ("first_pos", pa.int32()), ("open", pa.bool_()))
            batch = pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in kinds})
            for out in substring_dedup._settled(["k"], edges, columns[:5])(iter([batch])):
                got |= {(r["k"], r["doc_id"], r["pos"]): (r["first"], r["first_pos"]) for r in out.to_pylist()}
        assert got == want


def test_very_many_words(monkeypatch):
    """A passage of more different words than there are characters is cut, not refused."""
    source = [b"w%d" % i for i in range(1_200_000)]
    shard = substring_dedup.Shard(20)
    covered = 0
    for start, raw, anchors in shard.pieces(5, b" ".join(source), np.array([0, 399_990, 1_199_980])):
        assert shard.holds(raw)
        words = raw.split()
        assert words == source[start - 5 : start - 5 + len(words)]
        shard.learn(1, start, raw, anchors)
        shard.empty()
        covered += len(words) - 19
    assert covered == len(source) - 19


@pytest.mark.parametrize("vocabulary,places", [(500, 16), (3, 16), (3, 1), (2, 2)])
def test_shard_misses_nothing(vocabulary, places, monkeypatch):
    """Every equal window is found, also where phrases are crowded."""
    monkeypatch.setattr(substring_dedup, "PLACES", places)
    rng, hashes, width = random.Random(vocabulary), substring_dedup.WordHashes(), 20
    for _ in range(30):
        source = [b"%d" % rng.randrange(vocabulary) for _ in range(120)]
        other = source[10:60] + [b"x"] * rng.randrange(3) + source[rng.randrange(60) :]
        anchors = np.unique(substring_dedup.anchor_of_windows(hashes.of(source))[0])
        shard = substring_dedup.Shard(width)
        shard.learn(1, 0, b" ".join(source), anchors)
        automaton, known = shard.compiled(), {}
        for doc, words in ((1, source), (2, other)):
            known[doc] = np.zeros(len(words) - width + 1, np.int8)
            shard.locate(automaton, doc, 0, b" ".join(words), known[doc])
        windows = {doc: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] for doc, w in ((1, source), (2, other))}
        for doc in known:
            for i, window in enumerate(windows[doc]):
                earlier = [j for j, w in enumerate(windows[1]) if w == window and (1, j) < (doc, i)]
                assert known[doc][i] != 2 or earlier
                assert known[doc][i] == 2 or not earlier


def test_line_dedup(spark, rows):
    got = {r["doc_id"]: tuple(r) for r in line_dedup.line_report(frame(spark, rows)).collect()}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    blanks = " \t\n\x0b\x0c\r"
    holders = collections.defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and doc != max(holders[key(x)]))]
        joined = "\n".join(kept)
        assert got[doc] == (doc, len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode()).hexdigest())
        assert (texts[doc] or "") == joined
    assert got[66][2] == 2 and got[72][2] == 0


def test_jaccard_join(spark, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    sets = {}
    for doc, text, _ in rows:
        w = (text or "").split()
        n = min(5, len(w))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    links = {a: [b for b in sets if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in sets}
    for doc in sets:
        reached, front = {doc}, [doc]
        while front:
            front = [b for a in front for b in links[a] if b not in reached and not reached.add(b)]
        assert got[doc] == (min(reached), len(links[doc])), doc
    assert sum(n for _, n in got.values()) > 20
    kept = {r["doc_id"] for r in jaccard_join.near_dedup(frame(spark, rows)).collect()}
    assert kept == {d for d, (c, _) in got.items() if c == d}


def test_jaccard_blocks(spark, rows, monkeypatch):
    """Buckets and clusters cut into small blocks lose no link."""
    want = sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 2)
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows)).collect())) == want
    assert jaccard_join.NEEDED == sorted(jaccard_join.NEEDED) and 0 < jaccard_join.NEEDED[0] < 16


def test_mixing(spark, rows):
    report = mixing.mix_report(frame(spark, rows)).collect()
    sizes = {d: len((t or "").encode().split()) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    totals = collections.Counter()
    for d in sizes:
        totals[source[d]] += sizes[d]
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, left = {}, 1.5 * sum(totals.values()), set(order)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * totals[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s], rest = 2.0 * totals[s], rest - 2 * totals[s]
            left.remove(s)
    taken = collections.Counter()
    assert len(report) == len(rows)
    for r in report:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], totals[s])
        assert r["target"] == pytest.approx(target[s], rel=1e-9) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert target[s] - max(sizes[d] for d in sizes if source[d] == s) <= taken[s] <= target[s] + 1e-6
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(frame(spark, rows)).collect())
    assert all(mixed[r["doc_id"]] * r["size"] == r["taken"] for r in report) and mixed[62] == 1
    assert sorted(map(tuple, mixing.mix_report(frame(spark, rows)).collect())) == sorted(map(tuple, report))


def brute_segmentations(pieces, text, n):
    ways = {0: [(0.0, ())]}
    into = pieces.edges(text)
    for j in range(1, len(text) + 1):
        ways[j] = sorted(((a + s, w + ids) for i, s, ids in into[j] for a, w in ways[i]), key=lambda x: -x[0])[:500]
    return ways[len(text)][:n]


def test_segmentation(spark, rows):
    pieces = segmentation.Pieces()
    chunks = segmentation.Chunks(pieces)
    for text in ["hello world", "a", "  x  y ", "日本▁語 ok\n\n", "\x00é", "tttt tttt", " ", "\n", "x" * 25, "ab" * 12, "日" * 9]:
        ids, score, others = segmentation.segment(text, chunks, 4)
        want = brute_segmentations(pieces, " " + text, 4)
        assert [score, *[o["score"] for o in others]] == [w[0] for w in want]
        found = [tuple(ids.tolist()), *[tuple(segmentation.swapped(ids, o["swaps"])) for o in others]]
        assert len(set(found)) == len(found) and all(pieces.decode(i).decode() == text for i in found)
    encoded = segmentation.encode(frame(spark, [*rows, (99, "x" * 5000, "s"), (99, "x" * 5000, "s"), (None, "y", None)])).cache()
    back = sorted(((r["doc_id"], r["text"]) for r in segmentation.decode(encoded).collect()), key=str)
    assert back == sorted([*((d, t or "") for d, t, _ in rows), (99, "x" * 5000), (99, "x" * 5000), (None, "y")], key=str)
    for r in encoded.collect():
        scores = [r["score"], *[o["score"] for o in r["alternatives"]]]
        assert scores == sorted(scores, reverse=True)
    assert all(r["alternatives_decode"] for r in segmentation.report(encoded).collect())


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeo" for c in ("ning", "rest", "mol", "kast", "")]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilewort", "Vilewort,", "nastig", "nastigen"]))
        elif i % 6 == 1:
            text.insert(3, "sweet vilewort tea")
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "Vіlew0rt and n4stig and V.i.l.e.w.o.r.t nastiiiig", "s"), (1001, "sweet vilewort tea, sweet vilewort tea", "s"),
             (1002, None, "s"), (1003, "", "s"), (1004, "1234 *** !!!", "s"), (None, "nastig nastig nastig", None)]
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 1)
    assert {s for s in model.lexicon if "vilewort".startswith(s)} and {s for s in model.lexicon if "nastig".startswith(s)}
    got = toxicity.toxicity(docs, model)
    assert got.columns == [*docs.columns, "score", "predicted"]
    predicted = {r["doc_id"]: r["predicted"] for r in got.collect()}
    for i, _, toxic in labels:
        assert predicted[i] == toxic, (i, toxic, model)
    assert [predicted[i] for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 0, 0, 0, 0, 1]
    nothing = toxicity.fit(docs, marks.filter("false"), F.lit(True))
    assert toxicity.toxicity(docs, nothing).filter("predicted = 1").isEmpty()


def test_chat(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|> <\\|x"), (1, 0, "user", "<|im_start|>user\nyo"), (1, 2, "assistant", "日本 é"),
            (2, 0, "user", None), (2, None, None, "no turn"), (3, 5, "assistant", ""), (None, 1, "assistant", "lost"),
            (4, 0, "assistant", "y" * 100_000), (4, 0, "assistant", "y" * 100_000), (4, 1, "system", "\n")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, mask int, ids string")
    assembled = chat.assemble(chat.format_turns(table)).cache()
    got = {r["conv_id"]: r for r in chat.read_back(assembled).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        mine = [(r[2] or "", r[3] or "") for r in mine]
        said = "".join(t for role, t in mine if role == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (
            len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        offset = loss = 0
        for r in sorted((r for r in assembled.collect() if r["conv_id"] == conv), key=lambda r: r["offset"]):
            assert (r["offset"], r["loss_offset"]) == (offset, loss)
            offset, loss = offset + len(r["ids"]), loss + sum(r["mask"])
    for text in ["<|", "<\\|", "<\\\\|<|", "a<|im_end|>"]:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_repeated_and_nameless_rows(spark):
    """Rows that repeat a number are one document; rows without a number stay."""
    text = " ".join(f"q{i}" for i in range(30))
    docs = frame(spark, [(1, text, "a"), (1, text, "a"), (2, text, "a"), (2, "zz", "a"), (None, text, None), (None, text, None)])
    got = sorted(map(tuple, substring_dedup.substring_report(docs).collect()), key=str)
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 30, 0), (2, 30, 30), (None, 30, 0), (None, 30, 0)]
    assert sorted([r["doc_id"] for r in line_dedup.line_dedup(docs).collect()], key=str) == [1, 2, None, None]
    classes = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str)
    assert classes == [(1, 1, 1), (2, 1, 1), (None, None, 0), (None, None, 0)]
    assert sorted([r["doc_id"] for r in jaccard_join.near_dedup(docs).collect()], key=str) == [1, None, None]
    assert mixing.mix_report(docs).count() == 6


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x", "s")]).filter("false")
    for run in (substring_dedup.substring_report, substring_dedup.substring_dedup, line_dedup.line_report, line_dedup.line_dedup,
                jaccard_join.jaccard_join, jaccard_join.near_dedup, mixing.mix_report, mixing.mix, segmentation.encode):
        assert run(docs).isEmpty(), run
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.assemble(chat.format_turns(turns))).isEmpty()
