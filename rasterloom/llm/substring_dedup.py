"""Substring dedup: repeated passages found by sharded Aho-Corasick automata.

A window is ``width`` consecutive words of a document. Every word goes that a window covers whose word sequence
also starts earlier (in a document of smaller number, or earlier in the same one). Windows are judged on the input.

1. Anchors. Of the short word runs in a window the one with the least hash is its anchor, so equal windows have
   equal anchors at the same offset. Neighbouring windows share anchors: about one word in seven holds one.
   Anchor hashes are range-partitioned with document and position, so a common one is spread, and streamed:
   those that occur again are candidates, each with the first document that holds it.
2. Passages. Runs of windows whose anchors recur are cut out of the texts and sent to the shard of that
   first document; a shard with many runs is split, and only its first document's runs are copied.
3. Automata. A shard confirms passages on the words themselves: the anchor phrases of its first document become
   an automaton over word numbers, and all runs of the shard are streamed through it. Every hit lines a run up with a
   passage; stretches of equal words there are repetitions. Windows that differ from the first document (copies of an
   edited copy) are left over. Where an anchor phrase has many places in it, whole windows are looked up instead.
4. The few left-over windows are matched among each other by 128-bit digests, range-partitioned as in 1.

Documents without recurring anchors never leave the first join. Null and empty texts have no words. Rows that repeat a
``doc_id`` are one document (the least text). Rows without a ``doc_id`` keep all words and are nobody's source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import (
    WordHashes, binary, free_name, gram_hashes, group_starts, one_row_per_id, shuffle_partitions, signed, texts, whole_groups,
)

WIDTH, GRAM = 20, 8
# Anchors of one shard part; phrases, different words and streamed bytes of one automaton; places of a phrase.
PART_ANCHORS, AUTOMATON_PHRASES, AUTOMATON_WORDS, AUTOMATON_BYTES, PLACES = 50_000, 20_000, 400_000, 8_000_000, 16


def anchor_of_windows(words: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position of each window's anchor, hashes of all short runs)."""
    hashes = gram_hashes(words, gram)
    if len(words) < width:
        return np.empty(0, np.int64), hashes
    inside = np.lib.stride_tricks.sliding_window_view(hashes, width - gram + 1)
    return np.concatenate([
        inside[at : at + 65_536].argmin(1) + np.arange(at, min(at + 65_536, len(inside)))
        for at in range(0, len(inside), 65_536)]), hashes


def _anchors(width: int):
    def run(batches):
        numbers = WordHashes()
        for batch in batches:
            found, at, counts = [], [], []
            for raw in texts(batch, "text"):
                where, hashes = anchor_of_windows(numbers.of(raw.split()), width)
                where = where[np.flatnonzero(np.diff(where, prepend=-1))]
                found.append(hashes[where])
                at.append(where)
                counts.append(len(where))
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(signed(np.concatenate(found))),
                "doc_id": pa.array(np.repeat(batch.column("doc_id").to_numpy(), counts)),
                "pos": pa.array(np.concatenate(at).astype(np.int32))})

    return run


class Range:
    """One sorted range of (keys, doc_id, pos), streamed: rows of keys that occur again, with their earliest place.

    A key's rows may be spread over many batches and ranges, so only its first place is remembered. The first row of a key waits
    until a second one proves that it occurs again. Rows of the range's first key stay open, since the key may begin in
    an earlier range, and so does a last row that is alone; the range's summary says which keys stand at its edges.
    """

    def __init__(self, keys: list[str], schema: list[str]):
        self.keys, self.schema = keys, schema
        self.now, self.first = None, None  # key, place of its first row, rows so far; the same of the first key
        self.alone: pa.RecordBatch | None = None

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        starts = group_starts(batch, *self.keys)
        lengths = np.diff([*starts, n])
        head = np.repeat(starts, lengths)
        doc, pos = (batch.column(c).to_numpy() for c in ("doc_id", "pos"))
        first_doc, first_pos = doc[head], pos[head]
        key = lambda row: tuple(batch.column(k)[int(row)].as_py() for k in self.keys)
        again = np.repeat(lengths, lengths) > 1
        open_ = np.zeros(n, bool)
        goes_on = self.now is not None and self.now[0] == key(0)
        if goes_on:
            if self.alone is not None:
                yield self.made(self.alone, [self.now[1][0]], [self.now[1][1]], [False])
            first_doc[: lengths[0]], first_pos[: lengths[0]] = self.now[1]
            again[: lengths[0]] = True
        self.alone = None
        if self.first is None or (goes_on and self.first[0] == self.now[0]):
            open_[: lengths[0]] = True
            again[: lengths[0]] = True
            self.first = (key(0), (self.first or (None, (int(doc[0]), int(pos[0]))))[1], (self.first or (None, None, 0))[2] + int(lengths[0]))
        if len(starts) == 1 and goes_on:
            self.now = (self.now[0], self.now[1], self.now[2] + n)
        else:
            last = int(starts[-1])
            self.now = (key(last), (int(doc[last]), int(pos[last])), n - last)
            if n - last == 1 and not open_[last]:
                self.alone = batch.slice(last, 1)
        if again.any():
            yield self.made(batch.filter(pa.array(again)), first_doc[again], first_pos[again], open_[again])

    def made(self, rows, first, first_pos, open_) -> pa.RecordBatch:
        extra = {"first": pa.array(first, pa.int64()), "first_pos": pa.array(first_pos, pa.int32()), "open": pa.array(open_, pa.bool_()), "n": pa.nulls(rows.num_rows, pa.int64())}
        return pa.RecordBatch.from_pydict({c: extra[c] if c in extra else rows.column(c) for c in self.schema})

    def end(self) -> Iterator[pa.RecordBatch]:
        """The waiting row, and the summary: first and last key with their earliest place and number of rows."""
        if self.alone is not None:
            yield self.made(self.alone, [self.now[1][0]], [self.now[1][1]], [True])
        edges = {e[0]: e for e in (self.now, self.first) if e is not None}.values()
        made = {k: [e[0][i] for e in edges] for i, k in enumerate(self.keys)}
        made |= {"doc_id": [e[1][0] for e in edges], "pos": [e[1][1] for e in edges], "first": [None] * len(edges), "first_pos": [None] * len(edges),
                 "open": [None] * len(edges), "n": [e[2] for e in edges]}
        kinds = {"pos": pa.int32(), "first_pos": pa.int32(), "open": pa.bool_()}
        yield pa.RecordBatch.from_pydict({c: pa.array(made[c], kinds.get(c, pa.int64())) for c in self.schema})


def _recurring(keys: list[str], schema: list[str]):
    def run(batches):
        stream = Range(keys, schema)
        for batch in batches:
            if batch.num_rows:
                yield from stream.rows(batch)
        yield from stream.end()

    return run


def _settled(keys: list[str], edges: dict[tuple, tuple[int, int, int]], columns: list[str]):
    """All rows; open ones get the earliest place of their key over all ranges, and go if the key occurs once."""

    def run(batches):
        for batch in batches:
            open_ = np.flatnonzero(batch.column("open").to_numpy(zero_copy_only=False))
            rows = batch.select(columns)
            if not len(open_):
                yield rows
                continue
            some = rows.take(pa.array(open_))
            starts = group_starts(some, *keys)
            found = [edges[tuple(some.column(k)[int(i)].as_py() for k in keys)] for i in starts]
            places = np.repeat(np.array(found, np.int64), np.diff([*starts, len(open_)]), axis=0)
            first, first_pos = (rows.column(c).to_numpy(zero_copy_only=False).copy() for c in ("first", "first_pos"))
            first[open_], first_pos[open_] = places[:, 0], places[:, 1]
            keep = np.ones(batch.num_rows, bool)
            keep[open_] = places[:, 2] > 1
            extra = {"first": pa.array(first, pa.int64()), "first_pos": pa.array(first_pos, pa.int32())}
            yield pa.RecordBatch.from_pydict({c: extra[c] if c in extra else rows.column(c) for c in columns}).filter(pa.array(keep))

    return run


def recurring(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (keys, doc_id, pos) whose key occurs again, with ``first`` and ``first_pos``: its earliest place.

    Ranges of (keys, doc_id, pos) are sorted and streamed (see :class:`Range`). Every range reports the keys at its two
    edges; these at most two rows per shuffle partition are added up by key and looked up in the pass that reads the rows again.
    """
    order = [*keys, "doc_id", "pos"]
    columns = [*order, "first", "first_pos"]
    schema = ", ".join([*[f"{k} long" for k in keys], "doc_id long, pos int, first long, first_pos int"])
    ranges = rows.select(*order).repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    seen = stored(ranges.mapInArrow(_recurring(keys, [*columns, "open", "n"]), f"{schema}, open boolean, n long"), name)
    at = F.min(F.struct("doc_id", "pos")).alias("at")
    summed = seen.filter("n is not null").groupBy(*keys).agg(at, F.sum("n").alias("n")).collect()
    edges = {tuple(r[k] for k in keys): (r["at"]["doc_id"], r["at"]["pos"], r["n"]) for r in summed}
    return seen.filter("n is null").select(*columns, "open").mapInArrow(_settled(keys, edges, columns), schema)


def _squeezed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "z": pa.array([pack.compress(t) for t in texts(batch, "text")], pa.binary())})


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _parted(batches):
    """Documents without candidates are done; the others keep their text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        marked = batch.column("at").is_valid().to_numpy(zero_copy_only=False)
        packed = binary(batch.column("z")).to_pylist()
        words = [None if m else unpack.decompress(z).split() for m, z in zip(marked, packed)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "at": batch.column("at"),
            "z": pa.array([z if m else None for m, z in zip(marked, packed)], pa.binary()),
            "n_words": pa.array([None if w is None else len(w) for w in words], pa.int64()),
            "digest": pa.array([None if w is None else digest(w) for w in words], pa.string())})


def _passages(width: int):
    """Runs of windows whose anchors recur, one row per run and shard part."""

    def run(batches):
        unpack, numbers = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, z, marks in zip(batch.column("doc_id").to_pylist(), binary(batch.column("z")).to_pylist(), batch.column("at")):
                words = unpack.decompress(z).split()
                where, _ = anchor_of_windows(numbers.of(words), width)
                marks = marks.values
                pos = marks.field("pos").to_numpy()
                order = np.argsort(pos, kind="stable")
                pos, first = pos[order], marks.field("first").to_numpy()[order]
                parts = marks.field("parts").to_numpy()[order]
                at = np.minimum(np.searchsorted(pos, where), len(pos) - 1)
                hit = pos[at] == where
                shard = first[at]
                # A run ends where windows stop to be candidates or belong to another shard.
                change = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | (shard[1:] != shard[:-1])])
                for a, b in zip(change, [*change[1:], len(where)]):
                    if not hit[a]:
                        continue
                    own, copies = int(shard[a]), int(parts[at[a]])
                    text = b" ".join(words[a : b + width - 1])
                    anchors = (np.unique(where[a:b]) - a).astype(np.int32).tobytes() if own == doc else b""
                    for part in range(copies) if own == doc else [doc % copies]:
                        rows.append((own, part, own != doc, doc, int(a), text, anchors))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=RUN)

    return run


RUN = ["first", "part", "later", "doc_id", "start", "words", "anchors"]
PASSAGES = "first long, part int, later boolean, doc_id long, start int, words binary, anchors binary"


class Shard:
    """Passages of some first documents, their anchor phrases as an automaton over word numbers written as characters."""

    def __init__(self, width: int):
        self.width = width
        self.empty()

    def empty(self) -> None:
        self.numbers: dict[bytes, str] = {}
        self.phrases: dict[str, list[tuple[int, int]]] = {}
        self.passages: list[tuple[int, int, str, np.ndarray]] = []
        # Windows around crowded phrases, each with its earliest place.
        self.windows: dict[str, tuple[int, int]] = {}

    def pieces(self, start: int, raw: bytes, anchors: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """The passage in pieces of at most ``AUTOMATON_WORDS`` different words; every window lies in just one of them."""
        words, at = raw.split(b" "), 0
        if len(words) <= AUTOMATON_WORDS:
            yield start, raw, anchors
            return
        while at + self.width <= len(words):
            seen, end = set(), at
            while end < len(words) and (len(seen) < AUTOMATON_WORDS or words[end] in seen or end < at + self.width):
                seen.add(words[end])
                end += 1
            inside = anchors[(anchors >= at) & (anchors + GRAM <= end)]
            yield start + at, b" ".join(words[at:end]), inside - at
            at = end - self.width + 1

    def holds(self, raw: bytes) -> bool:
        """Whether there is room for the words of a passage (an empty shard has room for any piece)."""
        most = AUTOMATON_WORDS - len(self.numbers)
        return not self.numbers or raw.count(b" ") < most or len(set(raw.split(b" ")) - self.numbers.keys()) <= most

    def learn(self, doc: int, start: int, raw: bytes, anchors: np.ndarray) -> None:
        numbers = self.numbers
        text = "".join([numbers.setdefault(w, chr(_code(len(numbers)))) for w in raw.split(b" ")])
        for at in anchors.tolist():
            self.phrases.setdefault(text[at : at + GRAM], []).append((len(self.passages), at))
        self.passages.append((doc, start, text, _codes(text)))

    def spelled(self, raw: bytes) -> str:
        """Word numbers of a run as text; words that no passage holds are all alike."""
        get = self.numbers.get
        return "".join([get(w, "\0") for w in raw.split(b" ")])

    def full(self) -> bool:
        return len(self.phrases) >= AUTOMATON_PHRASES or len(self.numbers) >= AUTOMATON_WORDS

    def compiled(self) -> ahocorasick.Automaton:
        found, crowded = ahocorasick.Automaton(), {}
        for phrase, places in self.phrases.items():
            found.add_word(phrase, places)
            if len(places) > PLACES:
                for k, at in places:
                    crowded.setdefault(k, []).append(at)
        found.make_automaton()
        for k, places in crowded.items():
            doc, start, text, _ = self.passages[k]
            for i in self.around(places, len(text)):
                place, window = (doc, start + i), text[i : i + self.width]
                self.windows[window] = min(place, self.windows.get(window, place))
        return found

    def around(self, places: list[int], words: int) -> list[int]:
        """Starts of the windows that hold a phrase at one of ``places``."""
        change = np.zeros(words + 2, np.int64)
        np.add.at(change, np.maximum(0, np.array(places) - self.width + GRAM), 1)
        np.add.at(change, np.array(places) + 1, -1)
        return np.flatnonzero(np.cumsum(change)[: max(0, words - self.width + 1)]).tolist()

    def locate(self, automaton: ahocorasick.Automaton, doc: int, start: int, raw: bytes, known: np.ndarray) -> None:
        """Marks the windows of a run: 2 repeated, 1 the passage itself."""
        text = self.spelled(raw)
        codes, lined_up, crowded = _codes(text), set(), []
        for end, places in automaton.iter(text):
            at = end - GRAM + 1
            if len(places) > PLACES:
                crowded.append(at)
            else:
                lined_up.update((k, at - pos) for k, pos in places)
        for k, shift in lined_up:
            of, begin, _, passage = self.passages[k]
            if of == doc and begin - shift >= start:
                # Not earlier: the passage itself, or the mirror image of a repetition inside a document.
                if begin - shift == start:
                    own = known[shift : shift + len(passage) - self.width + 1]
                    np.maximum(own, 1, out=own)
                continue
            a, b = max(0, shift), min(len(codes), len(passage) + shift)
            differs = np.flatnonzero(codes[a:b] != passage[a - shift : b - shift])
            borders = np.concatenate([[-1], differs, [b - a]])
            for i in np.flatnonzero(np.diff(borders) > self.width):
                known[a + borders[i] + 1 : a + borders[i + 1] - self.width + 1] = 2
        for i in self.around(crowded, len(text)) if crowded else ():
            place = self.windows.get(text[i : i + self.width])
            if place is not None:
                known[i] = max(known[i], 2 if place < (doc, start + i) else 1)


def _code(n: int) -> int:
    """Character number of a word number; 0 and the surrogates are left out."""
    return n + 1 if n + 1 < 0xD800 else n + 1 + 0x800


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _located(width: int):
    """Stream the passages of each shard through its automata: covered words, and digests of left-over windows."""
    names = ["doc_id", "pos", "last", "h1", "h2"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def settle(shard: Shard, runs: list) -> None:
        if shard.phrases:
            automaton = shard.compiled()
            for doc, start, raw, known in runs:
                shard.locate(automaton, doc, start, raw, known)
        shard.empty()

    def rows_of(doc, start, raw, known):
        covered = np.flatnonzero(known == 2)
        # Neighbouring windows make one stretch.
        for some in np.split(covered, np.flatnonzero(np.diff(covered) > 1) + 1) if len(covered) else ():
            yield doc, start + int(some[0]), start + int(some[-1]) + width, None, None
        left_over = np.flatnonzero(known == 0)
        words = raw.split(b" ") if len(left_over) else []
        for i in left_over:
            h = hashlib.blake2b(b" ".join(words[i : i + width]), digest_size=16).digest()
            yield doc, start + int(i), None, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)

    def flushed(runs: list):
        rows = [r for run in runs for r in rows_of(*run)]
        runs.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

    def run(batches):
        shard, runs, waiting = Shard(width), [], 0
        for rows in whole_groups(batches, "first", "part"):
            rows = rows.combine_chunks()
            starts = group_starts(rows, "first", "part")
            for a, b in zip(starts, [*starts[1:], rows.num_rows]):
                group = rows.slice(a, b - a)
                later, docs, at = (group.column(c).to_pylist() for c in ("later", "doc_id", "start"))
                raws, part = group.column("words").to_pylist(), group.column("part")[0].as_py()
                # The first document is reported by one part only.
                mine = [(docs[i], at[i], raws[i], np.zeros(raws[i].count(b" ") + 2 - width, np.int8))
                        for i in range(len(raws)) if later[i] or part == 0]
                for i in range(later.index(True) if True in later else len(later)):
                    anchors = np.frombuffer(group.column("anchors")[i].as_py(), np.int32)
                    for piece in shard.pieces(at[i], raws[i], anchors):
                        # A large first document takes several automata, one after the other.
                        if shard.full() or not shard.holds(piece[1]):
                            settle(shard, [*runs, *mine])
                        shard.learn(docs[i], *piece)
                runs += mine
                waiting += sum(len(r[2]) for r in mine)
                if shard.full() or waiting > AUTOMATON_BYTES:
                    settle(shard, runs)
                    waiting = 0
                    yield flushed(runs)
        settle(shard, runs)
        yield flushed(runs)

    return run


def _search(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(documents parted by :func:`_parted`, covered stretches as doc_id, pos, last)."""
    known = docs.filter("doc_id is not null")
    # Written first: ranges are drawn from it, which would else mean to read all texts twice.
    anchors = stored(known.mapInArrow(_anchors(width), "anchor long, doc_id long, pos int"), "all-anchors")
    again = stored(recurring(anchors, ["anchor"], "anchors").select("doc_id", "pos", "first"), "recurring")
    large = stored(again.groupBy("first").agg(F.count("*").alias("n")).filter(F.col("n") > PART_ANCHORS).select(
        "first", F.ceil(F.col("n") / PART_ANCHORS).cast("int").alias("parts")), "large")
    marks = again.join(large, "first", "left").groupBy("doc_id").agg(
        F.collect_list(F.struct("pos", "first", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("at"))
    squeezed = docs.mapInArrow(_squeezed, "doc_id long, z binary")
    parted = stored(squeezed.join(marks, "doc_id", "left").mapInArrow(
        _parted, "doc_id long, at array<struct<pos int, first long, parts int>>, z binary, n_words long, digest string"), "parted")

    passages = parted.filter("z is not null").select("doc_id", "at", "z").mapInArrow(_passages(width), PASSAGES)
    passages = passages.repartition(shuffle_partitions(docs), "first", "part").sortWithinPartitions(
        "first", "part", "later", "doc_id", "start")
    found = stored(passages.mapInArrow(_located(width), "doc_id long, pos int, last int, h1 long, h2 long"), "located")
    rest = recurring(found.filter("h1 is not null"), ["h1", "h2"], "leftover").filter(
        "doc_id <> first or pos <> first_pos").select("doc_id", "pos", (F.col("pos") + width).cast("int").alias("last"))
    return parted, found.filter("h1 is null").select("doc_id", "pos", "last").unionByName(rest)


def kept_words(words: list[bytes], stretches) -> list[bytes]:
    """The words outside all stretches (first, one after the last)."""
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in stretches:
        gone[a] += 1
        gone[b] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep) if k]


def _joined(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    parted, covered = _search(docs, width)
    spans = covered.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "last")).alias("spans"))
    return parted.drop("at").filter("z is not null").join(spans, "doc_id", "left"), parted.filter("z is null")


def _stretches(column):
    for value in column:
        if not value.is_valid:
            yield ()
            continue
        value = value.values
        yield list(zip(value.field("pos").to_pylist(), value.field("last").to_pylist()))


def substring_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by blanks)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, gone, digests = [], [], []
            for z, spans in zip(binary(batch.column("z")).to_pylist(), _stretches(batch.column("spans"))):
                words = unpack.decompress(z).split()
                kept = kept_words(words, spans)
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(digest(kept))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    candidates, others = _joined(docs, width)
    done = others.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return done.unionByName(candidates.select("doc_id", "z", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, pos, last): stretches of words to remove, each once; they may overlap."""
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    return _search(docs, width)[1].distinct()


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns; texts that lose words become their kept words joined by blanks, ``n_chars``, if there, is counted anew."""
    docs = one_row_per_id(docs, "doc_id", "text")
    spans_of = free_name(docs, "_spans")
    spans = repeated_spans(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "last")).alias(spans_of))

    @F.pandas_udf("string")
    def kept(text: pd.Series, stretches: pd.Series) -> pd.Series:
        return pd.Series([
            t if s is None else b" ".join(kept_words((t or "").encode("utf-8", "replace").split(), [(x["pos"], x["last"]) for x in s])).decode("utf-8", "replace")
            for t, s in zip(text, stretches)], dtype=object)

    out = docs.join(spans, "doc_id", "left").withColumn("text", kept("text", spans_of))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
