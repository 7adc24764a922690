"""Similar boxes of whole images inside a task: numpy and plain-Python helpers of :mod:`ocr`.

Boxes that share more than half of their union hold each other's centres and differ by less than a factor of two in each
side. The index is by size and place: a box waits with its centre on its own level and those beside it, and is looked for on
one level, in the at most four cells that the other box touches. What a task holds is the words of the images it has begun.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BOX = ("left_px", "top_px", "width_px", "height_px")
# Words of whole images that are looked at together, and pairs that are compared at once.
CHUNK_WORDS, PAIRS = 1 << 16, 1 << 20


class KeptBoxes:
    """The boxes kept so far; the kept ones do not overlap much, so few of them wait in a cell."""

    def __init__(self):
        self.cells: dict[tuple, list] = {}

    def put(self, left: int, top: int, width: int, height: int) -> bool:
        """Whether the next box is kept, which it is unless it shares more than half of its union with a kept one."""
        if width <= 0 or height <= 0:
            return True
        cells, right, bottom, area = self.cells, left + width, top + height, width * height
        lx, ly = width.bit_length(), height.bit_length()
        for cx in range(left >> lx, (right - 1 >> lx) + 1):
            for cy in range(top >> ly, (bottom - 1 >> ly) + 1):
                for l, t, r, b, a in cells.get((lx, ly, cx, cy), ()):
                    across, down = min(right, r) - max(left, l), min(bottom, b) - max(top, t)
                    if across > 0 and down > 0 and 3 * across * down > area + a:
                        return False
        box = left, top, right, bottom, area
        for kx in (lx - 1, lx, lx + 1):
            for ky in (ly - 1, ly, ly + 1):
                cells.setdefault((kx, ky, left + right >> kx + 1, top + bottom >> ky + 1), []).append(box)
        return True


def kept_places(image: np.ndarray, boxes: list[np.ndarray]) -> np.ndarray:
    """Places of the words that stay; words come image by image, the most certain first."""
    out, here, kept = [], None, KeptBoxes()
    for at, (key, *box) in enumerate(zip(image.tolist(), *(b.tolist() for b in boxes))):
        if key != here:
            here, kept = key, KeptBoxes()
        if kept.put(*box):
            out.append(at)
    return np.array(out, np.int64)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One number of several; where different ones meet by chance, the comparison of the boxes tells them apart."""
    key = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        key = (key ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def similar(image: np.ndarray, boxes: list[np.ndarray], pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, share) for places of boxes that share more than half of their union, both orders, ``pairs`` candidates at a time.

    Boxes have an area. All pairs with the same ``a`` of one cell come together.
    """
    yield from _Index(image, boxes, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).met(pairs)


def similar_once(image: np.ndarray, boxes: list[np.ndarray], most: int = 64, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of every two such boxes, at least once; None where more than ``most`` candidates a box would be compared.

    A pair meets from one side or the other, so a box need not wait on all levels beside its own.
    """
    index = _Index(image, boxes, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])
    if index.candidates > most * max(len(image), 1024):
        return None
    found = [(a, b) for a, b, _ in index.met(pairs)]
    none = np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found] or [none]), np.concatenate([b for _, b in found] or [none])


class _Index:
    """Boxes by size and place; ``steps``: on which levels beside its own a box waits. Boxes have an area."""

    def __init__(self, image: np.ndarray, boxes: list[np.ndarray], steps: list[tuple[int, int]]):
        self.image = image
        left, top, width, height = self.boxes = [b.astype(np.int64) for b in boxes]
        right, bottom, all_ = left + width, top + height, np.arange(len(left))
        lx, ly = (np.frexp(s.astype(np.float64))[1].astype(np.int64) for s in (width, height))
        # A box waits only on levels where boxes look for others.
        looked = np.zeros((66, 66), bool)
        looked[lx, ly] = True
        waits, who = [], []
        for i, j in steps:
            at = np.flatnonzero(looked[lx + i, ly + j])
            kx, ky = lx[at] + i, ly[at] + j
            waits.append(_mixed(image[at], kx, ky, left[at] + right[at] >> kx + 1, top[at] + bottom[at] >> ky + 1))
            who.append(at)
        waits, who = np.concatenate(waits), np.concatenate(who)
        order = np.argsort(waits, kind="stable")
        waits, self.who = waits[order], who[order]
        looks, me = [], []
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            cx, cy = (left >> lx) + i, (top >> ly) + j
            at = np.flatnonzero((cx <= right - 1 >> lx) & (cy <= bottom - 1 >> ly))
            looks.append(_mixed(image[at], lx[at], ly[at], cx[at], cy[at]))
            me.append(at)
        looks, self.me = np.concatenate(looks), np.concatenate(me)
        self.first, self.end = waits.searchsorted(looks), waits.searchsorted(looks, "right")
        self.candidates = int((self.end - self.first).sum())

    def met(self, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, share) of similar boxes, ``pairs`` candidates at a time."""
        (left, top, width, height), image, me, first, end = self.boxes, self.image, self.me, self.first, self.end
        right, bottom, area = left + width, top + height, width * height
        ends = np.cumsum(end - first)
        at = 0
        while at < len(me):
            till = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + pairs, "right")))
            n = (end - first)[at:till]
            a = np.repeat(me[at:till], n)
            b = self.who[np.arange(len(a)) + np.repeat(first[at:till] - (np.cumsum(n) - n), n)]
            across = np.minimum(right[a], right[b]) - np.maximum(left[a], left[b])
            down = np.minimum(bottom[a], bottom[b]) - np.maximum(top[a], top[b])
            inter = np.maximum(across, 0) * np.maximum(down, 0)
            met = (a != b) & (image[a] == image[b]) & (3 * inter > area[a] + area[b])
            a, b, inter = a[met], b[met], inter[met]
            yield a, b, inter / (area[a] + area[b] - inter)
            at = till


def box_classes(image: np.ndarray, boxes: list[np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of every word, and of each class its first word by ``rank`` and its number of words; equal boxes are a class."""
    order = np.lexsort((rank, *boxes, image))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in (image, *boxes):
        new[1:] |= k[order][1:] != k[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new], np.bincount(of)


def best_rivals(image: np.ndarray, boxes: list[np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every box the one that it shares most with (-1: none), the first by ``rank`` of equal ones, and the share."""
    best, most = np.full(len(rank), -1), np.zeros(len(rank))
    solid = np.flatnonzero((boxes[2] > 0) & (boxes[3] > 0))
    for a, b, share in similar(image[solid], [s[solid] for s in boxes]):
        a, b = solid[a], solid[b]
        order = np.lexsort((rank[b], -share, a))
        a, b, share = a[order], b[order], share[order]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
        a, b, share = a[head], b[head], share[head]
        better = (best[a] < 0) | (share > most[a]) | ((share == most[a]) & (rank[b] < rank[best[a]]))
        best[a[better]], most[a[better]] = b[better], share[better]
    return best, most


def by_images(kernel: Callable[[pa.Table, np.ndarray, list[np.ndarray]], Iterator[pa.Table]], chunk: int = CHUNK_WORDS):
    """An iterator over batches that hands ``kernel`` whole images of rows sorted by ``image_id``, with their numbers and boxes."""

    def done(table: pa.Table, image: np.ndarray):
        for out in kernel(table, image, [table.column(c).to_numpy() for c in BOX]):
            yield from out.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk:
                continue
            table, image = _numbered(held)
            last = int(image.searchsorted(image[-1]))
            if last:
                yield from done(table.slice(0, last), image[:last])
            held = table.slice(last).to_batches()
            # An image that is larger than a chunk is looked at again when as much has come.
            rows = 0
        if held:
            table, image = _numbered(held)
            if len(image):
                yield from done(table, image)

    return run


def _numbered(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held)
    ids = table.column("image_id").combine_chunks().dictionary_encode(null_encoding="encode")
    return table, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
