"""Words of images as compact rows, and what a task makes of whole images: duplicates, lines, texts.

A compact row holds words of one image: byte planes of the numbers (differences where these are smaller), then the texts,
compressed. Words are packed as they come, so an image may have several rows; they meet before it is looked at. Everything here
works on columns of many images at once, and takes ``CHUNK_WORDS`` words at a time, or one image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rasterloom.operators import spots

NUMBERS = ("pass", "seq", "left_px", "top_px", "width_px", "height_px")
# Numbers that are kept as differences from the word before.
STEPS = (1, 2, 3)
COLUMNS = (*NUMBERS, "confidence", "text")
# Words that are packed together, and words of whole images that are looked at together.
PACKED_WORDS, CHUNK_WORDS = 1 << 17, 1 << 16
# Rows below so many bytes are not worth compressing.
SMALL = 256
# A row begins with its flags, the bytes of the rest before compression, and which byte planes it has.
PLANES = 8 * (len(COLUMNS) + 1)
HEAD = 1 + 4 + PLANES // 8
TENTHS, PRESSED = 1, 2


# ---- packing ----------------------------------------------------------------------------


def _zigzag(v: np.ndarray) -> np.ndarray:
    return (v << 1) ^ (v >> 63)


def _unzigzag(v: np.ndarray) -> np.ndarray:
    return (v.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(v & 1)


def _plain(column: pa.Array, kind) -> np.ndarray:
    """The values of a column, with zeros for nulls."""
    if column.null_count:
        column = column.fill_null(0)
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def packed(table: pa.Table) -> pa.RecordBatch:
    """(image_id, n, blob) of a table of words, a row per image."""
    ids = _one(_one(table.column("image_id")).dictionary_encode(null_encoding="encode"))
    image = ids.indices.to_numpy(zero_copy_only=False)
    if (image[1:] < image[:-1]).any():
        table = table.take(pa.array(np.argsort(image, kind="stable")))
        image = np.sort(image)
    starts = np.flatnonzero(np.append(True, image[1:] != image[:-1]))
    ends = np.append(starts[1:], len(image))
    text = _one(table.column("text")).cast(pa.string())
    text = pa.concat_arrays([text])
    bytes_ = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    places = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    numbers = np.zeros((len(image), PLANES // 8), np.int64)
    nulls = numbers[:, -1]
    for i, name in enumerate(NUMBERS):
        column = _one(table.column(name))
        v = _plain(column, np.int64)
        if i in STEPS:
            v = np.diff(v, prepend=0)
            v[starts] = _plain(column, np.int64)[starts]
        numbers[:, i] = _zigzag(v)
    confidence = _plain(_one(table.column("confidence")), np.float64)
    with np.errstate(invalid="ignore"):
        tenths = np.rint(confidence * 10)
        few = bool(((tenths / 10 == confidence) & (np.abs(tenths) < 1 << 40)).all()) and not np.signbit(confidence[confidence == 0]).any()
    numbers[:, len(NUMBERS)] = _zigzag(tenths.astype(np.int64)) if few else confidence.view(np.int64)
    numbers[:, len(NUMBERS) + 1] = np.diff(places)
    for i, name in enumerate(COLUMNS):
        column = _one(table.column(name))
        if column.null_count:
            nulls |= column.is_null().to_numpy(zero_copy_only=False).astype(np.int64) << i
    planes = numbers.view(np.uint8).reshape(len(image), PLANES)
    there = planes.any(axis=0)
    planes, mask = planes[:, there], np.packbits(there).tobytes()
    codec, blobs = pa.Codec("zstd", compression_level=3), []
    for s, e in zip(starts.tolist(), ends.tolist()):
        raw = planes[s:e].T.tobytes() + bytes_[places[s] : places[e]].tobytes()
        flags, size = TENTHS * few, len(raw)
        if size >= SMALL:
            raw, flags = codec.compress(raw, asbytes=True), flags | PRESSED
        blobs.append(bytes([flags]) + size.to_bytes(4, "little") + mask + raw)
    return pa.RecordBatch.from_arrays(
        [ids.dictionary.take(pa.array(image[starts])), pa.array(ends - starts, pa.int32()), pa.array(blobs, pa.binary())], ["image_id", "n", "blob"])


def pack(batches: Iterator[pa.RecordBatch], words: int = PACKED_WORDS) -> Iterator[pa.RecordBatch]:
    """Compact rows of words. Words of an image that follow each other are one row, up to ``words`` of them."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < words:
            continue
        table = pa.Table.from_batches(held)
        ids = _one(_one(table.column("image_id")).dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)
        other = np.flatnonzero(ids != ids[-1])
        # the last image may go on
        till = int(other[-1]) + 1 if len(other) else len(ids)
        yield packed(table.slice(0, till))
        held = table.slice(till).to_batches() if till < len(ids) else []
        rows = len(ids) - till
    if rows:
        yield packed(pa.Table.from_batches(held))


class Words:
    """Words of whole images, image by image: ``image`` is the number of a word's image, ``ids`` are the ids by that number."""

    def __init__(self, ids: pa.Array, image: np.ndarray, numbers: list[np.ndarray], confidence: np.ndarray, text: pa.Array, nulls: np.ndarray):
        self.ids, self.image, self.numbers, self.confidence, self.text, self.nulls = ids, image, numbers, confidence, text, nulls

    def __len__(self) -> int:
        return len(self.image)

    def null(self, column: int) -> np.ndarray | None:
        mask = self.nulls >> column & 1 != 0
        return mask if mask.any() else None

    @property
    def boxes(self) -> list[np.ndarray]:
        return self.numbers[2:]

    def certainty(self) -> list[np.ndarray]:
        """Less certain words, then passes, then places in the pass sort later; nulls first."""
        out = []
        for value, column, first in ((-self.confidence, 6, -np.inf), (self.numbers[0], 0, -(1 << 62)), (self.numbers[1], 1, -(1 << 62))):
            mask = self.null(column)
            out.append(value if mask is None else np.where(mask, first, value))
        return out

    def spelling(self) -> np.ndarray:
        return pc.rank(self.text, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> Words:
        if len(at) == len(self) and (at == np.arange(len(at))).all():
            return self
        return Words(self.ids, self.image[at], [v[at] for v in self.numbers], self.confidence[at], self.text.take(pa.array(at)), self.nulls[at])

    def columns(self, names: list[str], types: list[pa.DataType]) -> list[pa.Array]:
        """Columns of the words by name: ``image_id`` and those of :data:`COLUMNS`."""
        out = []
        for name, kind in zip(names, types):
            if name == "image_id":
                out.append(self.ids.take(pa.array(self.image)))
            elif name == "text":
                out.append(self.text)
            else:
                at = COLUMNS.index(name)
                value = self.confidence if name == "confidence" else self.numbers[at]
                out.append(pa.array(value.astype(kind.to_pandas_dtype()), kind, mask=self.null(at)))
        return out


def unpacked(ids: pa.Array, sizes: np.ndarray, blobs: list[bytes]) -> Words:
    """The words of compact rows, image by image."""
    groups: dict[bytes, list[int]] = {}
    for i, blob in enumerate(blobs):
        groups.setdefault(blob[0:1] + blob[5:HEAD], []).append(i)
    order = np.array([i for rows in groups.values() for i in rows], np.int64)
    numbers, texts, tenths = [], [], []
    codec = pa.Codec("zstd")
    for key, rows in groups.items():
        there = np.unpackbits(np.frombuffer(key[1:], np.uint8)).astype(bool)
        k, parts = int(there.sum()), []
        for i in rows:
            blob, n = blobs[i], int(sizes[i])
            raw = blob[HEAD:]
            if key[0] & PRESSED:
                raw = codec.decompress(raw, int.from_bytes(blob[1:5], "little"), asbytes=True)
            parts.append(np.frombuffer(raw, np.uint8, k * n).reshape(k, n))
            texts.append(raw[k * n :])
        planes = np.zeros((sum(p.shape[1] for p in parts), PLANES), np.uint8)
        planes[:, there] = np.concatenate(parts, axis=1).T
        numbers.append(planes.view(np.int64))
        tenths.append(np.full(len(planes), bool(key[0] & TENTHS)))
    numbers, tenths = np.concatenate(numbers), np.concatenate(tenths)
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    columns = [_unzigzag(np.ascontiguousarray(numbers[:, i])) for i in range(len(NUMBERS))]
    for i in STEPS:
        total = np.cumsum(columns[i])
        columns[i] = total - np.repeat(total[starts] - columns[i][starts], sizes)
    bits = np.ascontiguousarray(numbers[:, len(NUMBERS)])
    confidence = np.where(tenths, _unzigzag(bits) / 10, bits.view(np.float64))
    lengths, nulls = numbers[:, len(NUMBERS) + 1], np.ascontiguousarray(numbers[:, -1])
    places = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=places[1:])
    text = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(places), pa.py_buffer(b"".join(texts)))
    no_text = nulls >> COLUMNS.index("text") & 1 != 0
    if no_text.any():
        text = pc.if_else(pa.array(no_text), pa.scalar(None, pa.string()), text)
    ids = _one(ids.take(pa.array(order)).dictionary_encode(null_encoding="encode"))
    image = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    words = Words(ids.dictionary, image, columns, confidence, text, nulls)
    return words.take(np.argsort(image, kind="stable")) if (image[1:] < image[:-1]).any() else words


def whole_images(kernel: Callable[[Words], pa.Table | None], chunk: int = CHUNK_WORDS):
    """An iterator over compact rows, those of an image beside each other, that hands ``kernel`` whole images."""

    def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        out = kernel(unpacked(_one(table.column("image_id")), table.column("n").to_numpy().astype(np.int64), table.column("blob").to_pylist()))
        if out.num_rows:
            yield from out.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _one(batch.column("image_id").dictionary_encode(null_encoding="encode"))
            image, n = ids.indices.to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            at = 0
            # where a next image begins
            heads = np.append(np.flatnonzero(np.append(True, image[1:] != image[:-1])), len(image))
            for head, end in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if words >= chunk and not (head == 0 and held and held[-1].column("image_id")[-1] == batch.column("image_id")[0]):
                    if head > at:
                        held.append(batch.slice(at, head - at))
                    yield from done(held)
                    held, words, at = [], 0, head
                words += int(n[head:end].sum())
            if at < len(image):
                held.append(batch.slice(at))
        if held:
            yield from done(held)

    return run


# ---- whole images -----------------------------------------------------------------------


def _ordered(first: list[np.ndarray], rest: Callable[[], list[np.ndarray]]) -> np.ndarray:
    """Places in the order of ``first``, and of ``rest`` where these are equal."""
    at = np.lexsort(first[::-1])
    same = np.ones(max(len(at) - 1, 0), bool)
    for v in first:
        v = v[at]
        same &= v[1:] == v[:-1]
    return np.lexsort((*rest()[::-1], *first[::-1])) if same.any() else at


def kept(words: Words) -> np.ndarray:
    """Places of the words that stay: those that do not share more than half of their union with a more certain one that stays.

    Similar boxes are found through the index of :mod:`spots`, once each pair, and settled from the most certain word on. Where
    the index would compare too many boxes, each word is compared with kept ones of its cells only.
    """
    left, top, width, height = words.boxes
    solid = (width > 0) & (height > 0) & (words.nulls & 0b111100 == 0)
    at = np.flatnonzero(solid)
    boxes = [v[at] for v in (left, top, width, height)]
    order = lambda places: _ordered(
        [words.image[places], *[k[places] for k in words.certainty()]],
        lambda: [words.spelling()[places], *[b[places] for b in words.boxes]])
    found = spots.similar_once(words.image[at], boxes)
    if found is None:
        at = at[order(at)]
        stay = at[spots.kept_places(words.image[at], [b[at] for b in words.boxes])]
        return np.sort(np.concatenate([np.flatnonzero(~solid), stay]))
    a, b = at[found[0]], at[found[1]]
    involved = np.unique(np.concatenate([a, b]))
    rank = np.empty(len(words), np.int64)
    rank[involved[order(involved)]] = np.arange(len(involved))
    better = rank[a] < rank[b]
    a, b = np.where(better, a, b), np.where(better, b, a)
    pairs = np.argsort(rank[a], kind="stable")
    dropped = bytearray(len(words))
    for x, y in zip(a[pairs].tolist(), b[pairs].tolist()):
        if not dropped[x]:
            dropped[y] = 1
    return np.flatnonzero(np.frombuffer(dropped, np.uint8) == 0)


def lined(words: Words, edges: Callable) -> tuple[Words, np.ndarray]:
    """Words from top to bottom of every image, and their lines.

    A band opens below all earlier boxes, and with it a line. Where all boxes of a band reach below every centre, they are one
    line; else they stream past the lowest edges of the lines (``edges``).
    """
    left, top, _, height = words.boxes
    words = words.take(_ordered([words.image, top, left], lambda: [*words.certainty(), words.spelling(), *words.boxes[2:]]))
    _, top, _, height = words.boxes
    if not len(words):
        return words, np.zeros(0, np.int64)
    bottom = top + height
    # tops and bottoms have 33 bits
    apart = words.image << 35
    reached = np.maximum.accumulate(apart + bottom)
    opened = np.append(True, apart[1:] + top[1:] > reached[:-1])
    starts = np.flatnonzero(opened)
    ends = np.append(starts[1:], len(words))
    one = np.minimum.reduceat(bottom, starts) * 2 >= np.maximum.reduceat(2 * top + height, starts)
    line, count = np.zeros(len(words), np.int64), np.ones(len(starts), np.int64)
    for i in np.flatnonzero(~one).tolist():
        s, e = int(starts[i]), int(ends[i])
        low = edges()
        line[s:e] = [low.put(t, h) for t, h in zip(top[s:e].tolist(), height[s:e].tolist())]
        count[i] = low.lines
    # lines go on over the bands of an image
    before = np.cumsum(count) - count
    image = words.image[starts]
    heads = np.flatnonzero(np.append(True, image[1:] != image[:-1]))
    before -= np.repeat(before[heads], np.diff(np.append(heads, len(image))))
    return words, line + np.repeat(before, ends - starts)


def texts(words: Words, line: np.ndarray) -> pa.Table:
    """(image_id, text) of words with their lines: words by left, lines in order."""
    left, top = words.boxes[:2]
    at = _ordered([words.image, line, left, top], lambda: [*words.certainty(), words.spelling()])
    image, line, text = words.image[at], line[at], words.text.take(pa.array(at))
    new = np.append(True, (image[1:] != image[:-1]) | (line[1:] != line[:-1]))
    starts = np.flatnonzero(new)
    if text.null_count:
        there = text.is_valid()
        seen = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
        text, ends = text.filter(there), seen[np.append(starts, len(image))]
    else:
        ends = np.append(starts, len(image))
    rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text), " ")
    heads = np.flatnonzero(np.append(True, image[starts][1:] != image[starts][:-1]))
    pages = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(heads, len(starts)), pa.int32()), rows), "\n")
    return pa.table([words.ids.take(pa.array(image[starts][heads])), pages], ["image_id", "text"])


# ---- rows -------------------------------------------------------------------------------


def words_of(table: pa.Table, image: np.ndarray) -> Words:
    """Words of a table that lie image by image, ``image`` numbers these."""
    columns = {name: _one(table.column(name)) for name in COLUMNS}
    nulls = np.zeros(len(image), np.int64)
    for i, column in enumerate(columns.values()):
        if column.null_count:
            nulls |= column.is_null().to_numpy(zero_copy_only=False).astype(np.int64) << i
    ids = _one(_one(table.column("image_id")).dictionary_encode(null_encoding="encode")).dictionary
    return Words(ids, image, [_plain(columns[c], np.int64) for c in NUMBERS], _plain(columns["confidence"], np.float64), columns["text"], nulls)


def rows_of(names: list[str], types: list[pa.DataType]) -> Callable[[Words], pa.Table]:
    """Makes rows of words, and a column ``line`` if their lines are given."""

    def rows(words: Words, line: np.ndarray | None = None) -> pa.Table:
        columns = words.columns(names, types)
        if line is None:
            return pa.table(columns, names)
        return pa.table([*columns, pa.array(line.astype(np.int32))], [*names, "line"])

    return rows


def lists_of(names: list[str], types: list[pa.DataType]) -> Callable[[Words, np.ndarray], pa.Table]:
    """Makes a row per image of words with their lines: a list per column, words by line, then left."""

    def lists(words: Words, line: np.ndarray) -> pa.Table:
        left, top, width, height = words.boxes
        at = _ordered([words.image, line, left, top], lambda: [*words.certainty(), words.spelling(), width, height])
        words, line = Words(words.ids, words.image[at], [v[at] for v in words.numbers], words.confidence[at], words.text.take(pa.array(at)), words.nulls[at]), line[at]
        starts = np.flatnonzero(np.append(True, words.image[1:] != words.image[:-1]))
        offsets = pa.array(np.append(starts, len(words)), pa.int32())
        columns = dict(zip(names, words.columns(names, types))) | {"line": pa.array(line.astype(np.int32))}
        ids = words.ids.take(pa.array(words.image[starts]))
        return pa.table([ids, *[pa.ListArray.from_arrays(offsets, _one(v)) for c, v in columns.items() if c != "image_id"]],
                        ["image_id", *[c for c in columns if c != "image_id"]])

    return lists


def beside(kernel: Callable[[Words], tuple[Words, np.ndarray]], names: list[str], types: list[pa.DataType], chunk: int = CHUNK_WORDS):
    """An iterator over rows with a list ``_rows`` of the compact rows of an image, which become lists of its words by :func:`lists_of`.

    Other columns stay. Each row is an image of its own, whatever its id; a row without words has nulls.
    """
    lists = lists_of(names, types)
    fields = {c: t if c != "text" else pa.string() for c, t in zip(names, types) if c != "image_id"} | {"line": pa.int32()}

    def lists_for(rows: int, owner: np.ndarray, n: np.ndarray, blobs: list[bytes]) -> list[pa.Array]:
        if not len(owner):
            return [pa.nulls(rows, pa.list_(t)) for t in fields.values()]
        table = lists(*kernel(unpacked(pa.array(owner), n, blobs)))
        place = np.full(rows, -1)
        place[table.column("image_id").to_numpy()] = np.arange(table.num_rows)
        place = pa.array(place, mask=place < 0)
        return [_one(table.column(c)).take(place) for c in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, others = batch.column("_rows"), [c for c in batch.schema.names if c != "_rows"]
            counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rows.flatten()
            n, blobs = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("blob")
            ends = np.cumsum(counts)
            words = np.append(0, np.cumsum(n))
            at = 0
            while at < batch.num_rows:
                first = int(ends[at - 1]) if at else 0
                till = max(at + 1, int(words[ends].searchsorted(words[first] + chunk, "right")))
                last, part = int(ends[till - 1]), batch.slice(at, till - at)
                found = lists_for(till - at, np.repeat(np.arange(till - at), counts[at:till]), n[first:last], blobs.slice(first, last - first).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *found], [*others, *fields])
                at = till

    return run
