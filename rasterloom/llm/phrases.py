"""Phrase collocations by counting quotient filters over packed word ids.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.
Everything is per language.

1. Texts are read once. Each task turns its documents into blocks: a stream of block-local word numbers, 0 between pieces and
   documents, and the list of its words with counts. Long texts are cut between pieces, which no phrase crosses.
2. Block lists sum up to the vocabulary. A phrase that occurs often has only words that do, so the frequent
   ones get dense ids; the ids travel back to the blocks that hold the word (a join on the word, a list per block).
3. Two and three ids in a row are packed into one integer and scrambled by a Feistel network, a permutation of
   the packed integers, so nothing is lost and every key is evenly spread. The leading bits are the quotient, all others the
   remainder. A filter holds the sorted keys of one range of quotients: for each quotient the length of its run in
   unary bits, the remainders in as many bytes as they need, and one byte per counter, with the rare larger counts apart.
4. Filters of one range are merged by shard; where ranges would be too large for a task they are cut again by
   further bits, shuffle by shuffle. Counts of at least ``min_count`` are turned back into word ids.

Scores, containment and ranks are joins and grouped maxima over the candidates, in exact decimals.

A null text is empty, a null language is ``und``. Rows that repeat a document, with or without a number, all count. Languages and
words are compared as they are. Only ``lang`` and ``text`` are read; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import shuffle_partitions, texts

MIN_COUNT, TOP, INSIDE, UNIT = 10, 2000, 50, 1_000_000
# Words of a block; phrases a task holds before it writes filters; phrases that one range of a merge may hold.
BLOCK_WORDS, HELD, RANGE = 1 << 20, 1 << 21, 1 << 22
# Phrases that are scrambled at once.
PIECE = 1 << 18
# Bytes after which a long text is cut at the next end of a piece.
SLICE_BYTES = 1 << 20
# Bits that one shuffle can cut a range into.
CUT_BITS = 12
# Shares of a language whose best rows meet in its final ranking.
SHARES = 32
ROUND_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
# 0xFF is in no UTF-8 text, so it can stand for a separator.
FOLD = bytes(0xFF if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
BORDER = b"\xff"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, ``BORDER`` between pieces; long texts come in parts that end with a piece."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(BORDER, start + SLICE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[start:end].replace(BORDER, b" \xff ").split()
        start = end


class Numbers(dict):
    """Block-local numbers of the words of one language, from 1."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _blocks(size: int):
    """(block, stream, langs, words, counts) from documents."""

    def packed(block, of_lang, streams):
        # The numbers of the languages stand one after another; 0 is the border of all.
        before, langs, words = {}, [], []
        for lang, numbers in of_lang.items():
            before[lang] = len(words)
            langs += [lang] * (len(numbers) - 1)
            words += list(numbers)[1:]
        stream = np.concatenate([np.where(s > 0, s + before[lang], 0) for lang, s in streams]).astype(np.uint32)
        count = np.bincount(stream, minlength=len(words) + 1)[1:]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int64()), "stream": pa.array([stream.tobytes()], pa.binary()),
            "langs": pa.array([langs], pa.list_(pa.string())),
            "words": pa.array([[w.decode("utf-8", "replace") for w in words]], pa.list_(pa.string())),
            "counts": pa.array([count.tolist()], pa.list_(pa.int64()))})

    def run(batches):
        block, of_lang, streams, held = TaskContext.get().partitionId() << 33, {}, [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text")):
                for found in slices(text):
                    numbers = of_lang.setdefault(lang, Numbers({BORDER: 0}))
                    streams.append((lang, np.array([*map(numbers.__getitem__, found), 0], np.int64)))
                    held += len(found)
                    if held >= size:
                        yield packed(block, of_lang, streams)
                        block, of_lang, streams, held = block + 1, {}, [], 0
        if streams:
            yield packed(block, of_lang, streams)

    return run


BLOCKS = "block long, stream binary, langs array<string>, words array<string>, counts array<long>"


def with_ids(frequent: DataFrame) -> DataFrame:
    """Dense ids from 1, in the order of the written table; only sizes of its parts are summed up."""
    lines = stored(frequent.withColumn("line", F.monotonically_increasing_id()), "words")
    part = F.shiftright("line", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.col("line").bitwiseAND((1 << 33) - 1)
    # One row for each written part.
    return stored(lines.join(F.broadcast(starts), part == F.col("part")).select(
        (F.col("start") + own + 1).alias("id"), "lang", "word", "n"), "vocabulary")


# --- keys -----------------------------------------------------------------------------------------


class Packing:
    """Phrases of up to three ids of ``bits`` bits as a high and a low half, scrambled by a Feistel network and back."""

    def __init__(self, bits: int):
        self.bits = bits
        total = 3 * bits
        self.half = -(-total // 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def _mixed(self, x: np.ndarray, key: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0x94D049BB133111EB)
            return (y ^ (y >> np.uint64(32))) & self.mask

    def scramble(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the scrambled key of each phrase; a phrase of two has 0 as its third id."""
        a, b, c = (x.astype(np.uint64) for x in [*ids, np.zeros_like(ids[0])][:3])
        one, half = np.uint64(1), self.half
        # a, b, c side by side, cut into two halves.
        low_bits = half - self.bits
        low = ((b & ((one << np.uint64(low_bits)) - one)) << np.uint64(self.bits)) | c
        high = (a << np.uint64(self.bits - low_bits)) | (b >> np.uint64(low_bits))
        for key in ROUND_KEYS:
            high, low = low, high ^ self._mixed(low, key)
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        for key in reversed(ROUND_KEYS):
            high, low = low ^ self._mixed(high, key), high
        low_bits, one = self.half - self.bits, np.uint64(1)
        word = (one << np.uint64(self.bits)) - one
        a = high >> np.uint64(self.bits - low_bits)
        b = ((high & ((one << np.uint64(self.bits - low_bits)) - one)) << np.uint64(low_bits)) | (low >> np.uint64(self.bits))
        return [x.astype(np.int64) for x in (a, b, low & word)]


def counted(high: np.ndarray, low: np.ndarray, n: np.ndarray | None, half: int):
    """Sorted distinct keys with their counts."""
    if not len(high):
        return high, low, np.zeros(0, np.int64)
    if 2 * half <= 64:
        return counted_keys((high << np.uint64(half)) | low, n, half)
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], None if n is None else n[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    return high[at], low[at], _totals(at, len(new), n)


def counted_keys(key: np.ndarray, n: np.ndarray | None, half: int):
    """The same of both halves in one number; ``key`` is sorted in place where nothing goes with it."""
    if n is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return key >> np.uint64(half), key & np.uint64((1 << half) - 1), _totals(at, len(new), n)


def _totals(at: np.ndarray, end: int, n: np.ndarray | None) -> np.ndarray:
    return (np.diff(np.append(at, end)) if n is None else np.add.reduceat(n, at)).astype(np.int64)


# --- filters --------------------------------------------------------------------------------------


def _bytes_of(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _ints_of(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width if width else 0, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def pack_filter(high: np.ndarray, low: np.ndarray, n: np.ndarray, half: int, fixed: int) -> dict[str, bytes]:
    """A filter of sorted keys whose ``fixed`` leading bits are equal."""
    # About one quotient per key.
    q = max(0, min(half - fixed, int(len(high)).bit_length() - 1))
    rest = half - fixed - q
    inside = high & np.uint64((1 << (half - fixed)) - 1)
    quotient = (inside >> np.uint64(rest)).astype(np.int64)
    run = np.bincount(quotient, minlength=1 << q)
    # A run of k keys is k ones and a zero.
    bits = np.ones(len(high) + (1 << q), bool)
    bits[np.cumsum(run + 1) - 1] = False
    large = np.flatnonzero(n >= 255)
    return {
        "head": np.array([len(high), q, fixed], np.int64).tobytes(), "runs": np.packbits(bits).tobytes(),
        "high": _bytes_of(inside & np.uint64((1 << rest) - 1), -(-rest // 8)), "low": _bytes_of(low, -(-half // 8)),
        "counts": np.minimum(n, 255).astype(np.uint8).tobytes(),
        "large": np.stack([large, n[large]], 1).astype(np.int64).tobytes()}


def open_filter(row: dict[str, bytes], shard: int, half: int):
    """The sorted keys of a filter and their counts."""
    size, q, fixed = np.frombuffer(row["head"], np.int64)
    rest = half - int(fixed) - int(q)
    bits = np.unpackbits(np.frombuffer(row["runs"], np.uint8), count=int(size) + (1 << int(q))).astype(bool)
    quotient = np.cumsum(~bits)[bits].astype(np.uint64)
    high = quotient << np.uint64(rest)
    if rest:
        high |= _ints_of(row["high"], -(-rest // 8))
    if fixed:
        high |= np.uint64(shard) << np.uint64(half - int(fixed))
    n = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
    large = np.frombuffer(row["large"], np.int64).reshape(-1, 2)
    n[large[:, 0]] = large[:, 1]
    return high, _ints_of(row["low"], -(-half // 8)), n


FILTER = "words int, shard long, head binary, runs binary, high binary, low binary, counts binary, large binary"
PIECES = ("head", "runs", "high", "low", "counts", "large")


def _filters(words: int, high, low, n, half: int, fixed: int):
    """Rows of filters, one per range of ``fixed`` leading bits."""
    if not len(high):
        return
    shard = (high >> np.uint64(half - fixed)).astype(np.int64) if fixed else np.zeros(len(high), np.int64)
    heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    rows = []
    for a, b in zip(heads, np.append(heads[1:], len(shard))):
        rows.append({"words": words, "shard": int(shard[a])} | pack_filter(high[a:b], low[a:b], n[a:b], half, fixed))
        if len(rows) == 512:
            yield _filter_batch(rows)
            rows = []
    if rows:
        yield _filter_batch(rows)


def _filter_batch(rows):
    return pa.RecordBatch.from_pydict({
        "words": pa.array([r["words"] for r in rows], pa.int32()), "shard": pa.array([r["shard"] for r in rows], pa.int64()),
        **{c: pa.array([r[c] for r in rows], pa.binary()) for c in PIECES}})


def _phrases(bits: int, fixed: int, held: int):
    """Filters of the phrases of two and three frequent words in blocks of ``stream`` with ``locals``, ``ids``."""
    packing = Packing(bits)
    half = packing.half

    def scrambled(ids):
        # Keys of up to 64 bits wait as one number.
        high, low = packing.scramble(ids)
        return ((high << np.uint64(half)) | low,) if 2 * half <= 64 else (high, low)

    def run(batches):
        waiting = {2: [], 3: []}
        size = {2: 0, 3: 0}

        def flushed(k):
            parts, waiting[k], size[k] = waiting[k], [], 0
            keys = [np.concatenate(of) for of in zip(*parts)]
            parts.clear()
            yield from _filters(k, *(counted_keys(keys.pop(), None, half) if len(keys) == 1 else counted(*keys, None, half)), half, fixed)

        for batch in batches:
            for row in range(batch.num_rows):
                stream = np.frombuffer(batch.column("stream")[row].as_py(), np.uint32)
                local = batch.column("local")[row].values.to_numpy()
                of = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
                of[local] = batch.column("ids")[row].values.to_numpy()
                g = of[stream]
                two = (g[:-1] > 0) & (g[1:] > 0)
                three = two[:-1] & two[1:]
                for k, at in ((2, np.flatnonzero(two)), (3, np.flatnonzero(three))):
                    for start in range(0, len(at), PIECE):
                        waiting[k].append(scrambled([g[at[start : start + PIECE] + i] for i in range(k)]))
                    size[k] += len(at)
                    if size[k] >= held:
                        yield from flushed(k)
        for k in (2, 3):
            if size[k]:
                yield from flushed(k)

    return run


def _merged(bits: int, deeper: int | None, least: int, held: int):
    """Merges a partition's filters, sorted by (words, shard): into filters of ``deeper`` bits, or into counts."""
    packing = Packing(bits)

    def finished(words, keys):
        if deeper is not None:
            yield from _filters(words, *keys, packing.half, deeper)
            return
        high, low, n = keys
        enough = n >= least
        a, b, c = packing.restore(high[enough], low[enough])
        yield pa.RecordBatch.from_pydict({
            "words": pa.array(np.full(len(a), words), pa.int32()), "w1": pa.array(a), "w2": pa.array(b), "w3": pa.array(c), "a": pa.array(n[enough])})

    def run(batches):
        own, parts, size = None, [], 0

        def merged():
            keys = [np.concatenate(of) for of in zip(*parts)]
            parts.clear()
            return counted(*keys, packing.half)

        for batch in batches:
            for nth in range(batch.num_rows):
                row = {c: batch.column(c)[nth].as_py() for c in batch.schema.names}
                at = (row["words"], row["shard"])
                if at != own:
                    if parts:
                        yield from finished(own[0], merged())
                    own, parts, size = at, [], 0
                keys = open_filter(row, row["shard"], packing.half)
                parts.append(keys)
                size += len(keys[0])
                if size >= held and len(parts) > 1:
                    parts = [merged()]
                    size = 0
                    if deeper is not None:  # a coarse range need not be whole before it is cut
                        yield from finished(own[0], parts[0])
                        parts = []
        if parts:
            yield from finished(own[0], merged())

    return run


def cuts(phrases: int, tasks: int, range_: int, half: int, bits: int = CUT_BITS) -> list[int]:
    """Leading bits after each shuffle, so that a range of the last one holds about ``range_`` phrases, and tasks have work."""
    need = min(half, max((phrases // range_).bit_length(), (tasks - 1).bit_length()))
    return [min(need, (i + 1) * bits) for i in range(max(1, -(-need // bits)))]


# --- the operator ---------------------------------------------------------------------------------


def counts(docs: DataFrame, min_count: int = MIN_COUNT, block_words: int = BLOCK_WORDS, held: int = HELD, range_: int = RANGE, cut_bits: int = CUT_BITS):
    """(vocabulary, totals, phrases): words (id, lang, word, n) and phrases (words, w1, w2, w3, a) of at least ``min_count``
    occurrences, and the words of every language (lang, n)."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    blocks = stored(read.mapInArrow(_blocks(block_words), BLOCKS), "blocks")
    lists = F.arrays_zip("langs", "words", "counts")
    listed = blocks.select("block", F.posexplode(lists).alias("at", "w")).select(
        "block", (F.col("at") + 1).alias("local"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    sums = stored(listed.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = stored(sums.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    vocabulary = with_ids(sums.filter(F.col("n") >= min_count))
    known, words = vocabulary.agg(F.max("id")).first()[0] or 0, totals.agg(F.sum("n")).first()[0] or 0
    bits = max(2, int(known).bit_length())
    tasks = shuffle_partitions(docs)
    steps = cuts(2 * words, tasks, range_, Packing(bits).half, cut_bits)
    # A word that every block holds is one row per block here; the join may split it.
    ids = listed.select("block", "local", "lang", "word").join(vocabulary.select("id", "lang", "word"), ["lang", "word"])
    ids = ids.groupBy("block").agg(F.collect_list(F.struct("local", "id")).alias("m"))
    numbered = blocks.select("block", "stream").join(ids, "block").select("stream", F.col("m.local").alias("local"), F.col("m.id").alias("ids"))
    filters = numbered.mapInArrow(_phrases(bits, steps[0], held), FILTER)
    for i in range(len(steps)):
        last = i == len(steps) - 1
        met = filters.repartition(tasks, "words", "shard").sortWithinPartitions("words", "shard")
        out = "words int, w1 long, w2 long, w3 long, a long" if last else FILTER
        filters = met.mapInArrow(_merged(bits, None if last else steps[i + 1], min_count, held), out)
    return vocabulary, totals, stored(filters, "phrases")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, inside: int = INSIDE, unit: int = UNIT, **sizes) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that stay."""
    vocabulary, totals, found = counts(docs, min_count, **sizes)
    two = found.filter("words = 2").select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("a").alias("f"))
    three = found.filter("words = 3").select("w1", "w2", "w3", "a")
    # Pairs inside a longer candidate that is frequent enough are gone.
    longer = three.select(F.col("w1").alias("x"), F.col("w2").alias("y"), "a").unionByName(
        three.select(F.col("w2").alias("x"), F.col("w3").alias("y"), "a")).groupBy("x", "y").agg(F.max("a").alias("most"))
    pairs = two.join(longer, ["x", "y"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("f")))
    word = lambda i: vocabulary.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("n").alias(f"f{i}"), *[F.col("lang")] * (i == 1))

    def score(a, l, r):
        exact = lambda c: c.cast("decimal(19,0)")
        part = exact(a) * exact(a) * F.lit(unit).cast("decimal(7,0)")
        return F.call_function("div", part.cast("decimal(38,0)"), (exact(l) * exact(r)).cast("decimal(38,0)"))

    a = F.col("a")
    named = pairs.select(F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("f").alias("a")).join(word(1), "w1").join(word(2), "w2")
    named = named.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(a, F.col("f1"), F.col("f2")).alias("score"))
    head = two.select(F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("f").alias("f12"))
    tail = two.select(F.col("x").alias("w2"), F.col("y").alias("w3"), F.col("f").alias("f23"))
    wide = three.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    first = F.struct(score(a, F.col("f1"), F.col("f23")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r"))
    second = F.struct(score(a, F.col("f12"), F.col("f3")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r"))
    wide = wide.withColumn("best", F.least(first, second)).select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "best.l", "best.r", "best.score")
    return named.unionByName(wide).join(totals, "lang")


def best(ranked: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of every language with their ``rank``; a large language is cut down in shares first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for shares in (shuffle_partitions(ranked), SHARES, 1):
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        rows = F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))
        ranked = ranked.withColumn("rank", rows.cast("long")).filter(F.col("rank") <= top)
    return ranked


def report(docs: DataFrame, top: int = TOP, **parameters) -> DataFrame:
    """The ``top`` phrases of every language."""
    return best(collocations(docs, **parameters), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
