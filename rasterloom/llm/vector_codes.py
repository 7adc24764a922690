"""Vector codes: one codebook per part of the vectors, improved by Lloyd's rounds over cover trees.

Components become integers (floor of ``scale`` times the component) and vectors are cut into ``parts`` equal consecutive
parts. A part's codebook starts as that part of the vectors with the ``entries`` smallest ids; a round assigns every part to
its nearest entry (ties to the lower index) and moves every used entry to the componentwise floor of the mean of its parts.

Each task builds cover trees over chunks of its vectors, one tree per part, and writes them once; all rounds read
them. The points of a tree are ordered so that every node is a range of them whose first point is its centre; the node
knows its radius, and sums of a range are differences of running sums. A round goes down the levels of all trees of
a chunk at once: where the nearest entry of a centre beats the second by more than twice the radius, the
triangle inequality gives the whole range to that entry; ambiguous nodes are opened, ambiguous leaves compared point
by point in exact arithmetic. Only sums per entry (a fixed number) leave a task.

Rows without ``vec_id`` and vectors that are null, hold null or non-finite components, or reach ``LARGEST`` after scaling are
dropped. So are vectors whose length differs from that of the smallest id whose length is a positive multiple of ``parts``.
Rows that repeat a ``vec_id`` are one vector (the least). With fewer vectors than entries, a codebook is as long as
there are vectors. Null labels are one label. Errors above the largest long are returned as that. Only ``vec_id``, ``embedding``
and ``label`` are read; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import one_row_per_id
from rasterloom.llm.pivot_search import finite

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
# Vectors of one chunk (one tree per part), and points below which a node is not split.
CHUNK, LEAF = 4096, 16
LARGEST = 2.0**90
LONGEST_LONG = (1 << 63) - 1


def exact(x: np.ndarray, bound: float) -> np.ndarray:
    """The integers that the doubles ``x`` hold, as a type in which sums of ``bound`` in size are exact."""
    if bound < 2.0**52:
        return x
    if bound < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start at ``lo``."""
    before = np.cumsum(size) - size
    return np.repeat(lo - before, size) + np.arange(int(size.sum()))


def cover_trees(x: np.ndarray, roots: np.ndarray, leaf: int = LEAF):
    """Trees over the points of each range ``roots[i]:roots[i + 1]``, all built level by level together.

    Returns the order of the points and, per node, (first, last, first child, children) and its radius. The children of a
    node lie within its radius, each covers half of it around its centre, and centres of one node are further than
    that apart.
    """
    order = np.arange(len(x))
    lo, hi = roots[:-1].copy(), roots[1:].copy()
    lo, hi = lo[hi > lo], hi[hi > lo]
    levels, made = [], len(lo)
    while len(lo):
        size = hi - lo
        at, owner = ranges(lo, size), np.repeat(np.arange(len(lo)), size)
        p = x[order[at]]
        starts = np.cumsum(size) - size
        square = ((p - p[np.repeat(starts, size)]) ** 2).sum(1)
        radius = np.sqrt(np.maximum.reduceat(square, starts)) * (1 + 1e-9)
        split = (size > leaf) & (radius > 0)
        child, kids = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        inner = split[owner]
        at, owner, p = at[inner], owner[inner], p[inner]
        half = ((radius / 2) ** 2)[owner]
        claimed, left, number = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(left):
            own = owner[left]
            first = np.ones(len(left), bool)
            first[1:] = own[1:] != own[:-1]
            lead = left[first][np.cumsum(first) - 1]
            near = ((p[left] - p[lead]) ** 2).sum(1) <= half[left]
            claimed[left[near]] = number
            left, number = left[~near], number + 1
        by_child = np.lexsort((claimed, owner))
        order[at] = order[at][by_child]
        owner, claimed = owner[by_child], claimed[by_child]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (claimed[1:] != claimed[:-1])
        heads = np.flatnonzero(new)
        kids = np.bincount(owner[heads], minlength=len(lo))
        child[split] = made + (np.cumsum(kids) - kids)[split]
        levels.append((np.stack([lo, hi, child, kids], 1), radius))
        # A parent's range is contiguous, so a child ends where the next head of the same parent stands.
        lo = at[heads]
        hi = lo + np.diff(np.append(heads, len(at)))
        made += len(lo)
    if not levels:
        return order, np.zeros((0, 4), np.int64), np.zeros(0)
    return order, np.concatenate([n for n, _ in levels]), np.concatenate([r for _, r in levels])


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points to entries; exact where the types are."""
    return (x * x).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * (x @ book.T)


class Chunk:
    """Vectors with their trees; ``x`` holds all parts, one after another, as rows."""

    def __init__(self, vectors: np.ndarray, parts: int, leaf: int = LEAF, trees=None):
        self.n, self.parts = len(vectors), parts
        self.x = vectors.reshape(self.n, parts, -1).transpose(1, 0, 2).reshape(self.n * parts, -1)
        self.order, self.nodes, self.radius = trees or cover_trees(self.x, np.arange(parts + 1) * self.n, leaf)
        self.points = self.x[self.order]
        self.most = float(np.abs(self.x).max(initial=0))

    def assign(self, books: np.ndarray):
        """Entry of every point in tree order, and how many points were compared one by one."""
        width = self.x.shape[1]
        most = max(self.most, max((abs(float(v)) for v in books.ravel()), default=0.0))
        bound = 4.0 * width * most * most
        rough = books.astype(np.float64)
        fine = exact(rough, bound) if bound < 2.0**62 else books
        entry = np.zeros(len(self.x), np.int64)
        near, compared = np.arange(min(self.parts, len(self.nodes))), 0
        while len(near):
            lo, hi, child, kids = self.nodes[near].T
            part = lo // self.n
            centres, best, safe = self.points[lo], np.zeros(len(near), np.int64), np.zeros(len(near), bool)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                d = squares(centres[mine], rough[p])
                best[mine] = d.argmin(1)
                if d.shape[1] == 1:
                    safe[mine] = True
                    continue
                two = np.partition(d, 1, axis=1)[:, :2]
                slack = 1e-12 * bound
                reach = np.sqrt(np.maximum(two[:, 0] + slack, 0)) + 2 * self.radius[near[mine]]
                safe[mine] = reach * (1 + 1e-9) < np.sqrt(np.maximum(two[:, 1] - slack, 0))
            entry[ranges(lo[safe], (hi - lo)[safe])] = np.repeat(best[safe], (hi - lo)[safe])
            point = ~safe & (kids == 0)
            # Equal points need one comparison.
            alike = self.radius[near] == 0
            look, size = lo[point], np.where(alike, 1, hi - lo)[point]
            where = ranges(look, size)
            found = np.zeros(len(where), np.int64)
            parts = where // self.n
            for p in np.unique(parts):
                mine = parts == p
                found[mine] = squares(exact(self.points[where[mine]], bound), fine[p]).argmin(1)
            compared += len(where)
            entry[where] = found
            same = point & alike
            entry[ranges(lo[same], (hi - lo)[same])] = np.repeat(entry[lo[same]], (hi - lo)[same])
            down = ~safe & (kids > 0)
            near = ranges(child[down], kids[down])
        return entry, compared

    def sums(self, entry: np.ndarray, entries: int):
        """Count and sums of the points of every (part, entry), from running sums over ranges of equal entries."""
        width = self.x.shape[1]
        kind = object if self.most * len(self.x) >= 2.0**62 else np.int64
        running = np.concatenate([np.zeros((1, width), kind), np.cumsum(exact(self.points, 2.0**62 if kind is object else 2.0**60).astype(kind), axis=0)])
        part = np.arange(len(entry)) // self.n
        new = np.ones(len(entry), bool)
        new[1:] = (entry[1:] != entry[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(entry))
        count, total = np.zeros((self.parts, entries), np.int64), np.zeros((self.parts, entries, width), kind)
        np.add.at(count, (part[heads], entry[heads]), ends - heads)
        np.add.at(total, (part[heads], entry[heads]), running[ends] - running[heads])
        return count, total

    def codes(self, entry: np.ndarray, books: np.ndarray):
        """Codes (a row per vector, a byte per part) and errors, in the order of the vectors."""
        width = self.x.shape[1]
        code = np.zeros(len(entry), np.int64)
        code[self.order] = entry
        most = max(self.most, max((abs(float(v)) for v in books.ravel()), default=0.0))
        bound = 4.0 * width * self.parts * most * most
        x = exact(self.x, bound)
        book = exact(books.astype(np.float64), bound) if bound < 2.0**62 else books
        gap = x - book[np.arange(len(code)) // self.n, code]
        error = (gap * gap).sum(1).reshape(self.parts, self.n).sum(0)
        return code.reshape(self.parts, self.n).T, [min(int(e), LONGEST_LONG) for e in error]


def _chunks(scale: float, parts: int, size: int):
    """Builds and packs the trees of a task's vectors, ``size`` vectors at a time."""

    def packed(ids, labels, vectors):
        x = np.floor(np.concatenate(vectors) * scale).reshape(len(vectors), -1)
        chunk = Chunk(x, parts)
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
            "labels": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(labels)),
            "x": pa.array([x.tobytes()], pa.binary()),
            "orders": pa.array([chunk.order.astype(np.int32).tobytes()], pa.binary()),
            "nodes": pa.array([chunk.nodes.astype(np.int32).tobytes()], pa.binary()),
            "radius": pa.array([chunk.radius.tobytes()], pa.binary())})

    def run(batches):
        ids, labels, vectors = [], [], []
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                ids.extend(some.column("vec_id").to_pylist())
                labels.append(some.column("label"))
                vectors.extend(v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in some.column("embedding"))
                if len(ids) >= size:
                    yield packed(ids, labels, vectors)
                    ids, labels, vectors = [], [], []
        if ids:
            yield packed(ids, labels, vectors)

    return run


def _opened(batches, parts: int):
    """(ids, labels, chunk) of every packed row."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)
            ids = get("ids", np.int64)
            trees = (get("orders", np.int32).astype(np.int64), get("nodes", np.int32).astype(np.int64).reshape(-1, 4), get("radius", np.float64))
            yield ids, batch.column("labels")[row].values, Chunk(get("x", np.float64).reshape(len(ids), -1), parts, trees=trees)


def _moved(books: np.ndarray):
    """Sums of a task's parts by entry: (part, entry, pos, n, total), at most one row per component of a codebook."""
    parts, entries, width = books.shape

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)
        for _, _, chunk in _opened(batches, parts):
            c, t = chunk.sums(chunk.assign(books)[0], entries)
            count += c
            total += t
        part, entry = np.nonzero(count)
        pos = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.repeat(part, width), pa.int32()), "entry": pa.array(np.repeat(entry, width), pa.int32()),
            "pos": pa.array(pos, pa.int32()), "n": pa.array(np.repeat(count[part, entry], width), pa.int64()),
            "total": pa.array([str(v) for v in total[part, entry].ravel()], pa.string())})

    return run


def _coded(books: np.ndarray, label: str):
    def run(batches):
        for ids, labels, chunk in _opened(batches, len(books)):
            codes, errors = chunk.codes(chunk.assign(books)[0], books)
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(ids), "label": labels,
                "code": pa.array([bytes(c).hex() if books.shape[1] <= 256 else "".join(f"{v:04x}" for v in c) for c in codes.astype(np.uint8 if books.shape[1] <= 256 else np.int64)], pa.string()),
                "error": pa.array(errors, pa.int64())})

    return run, f"vec_id long, label {label}, code string, error long"


def train(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, chunk: int = CHUNK):
    """The packed trees and the codebooks, an array (part, entry, component) of integers; None without vectors."""
    rows = one_row_per_id(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), "vec_id", "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & finite("embedding"))
    rows = rows.filter(F.forall("embedding", lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < LARGEST))
    length = F.size("embedding")
    dim = rows.filter((length > 0) & (length % parts == 0)).agg(F.min_by(length, "vec_id")).first()[0]
    if dim is None:
        return None, None
    rows = rows.filter(length == dim)
    start = rows.orderBy("vec_id").limit(entries).collect()
    first = np.floor(np.array([r["embedding"] for r in start], np.float64) * scale).reshape(len(start), parts, -1).transpose(1, 0, 2)
    books = np.array([int(v) for v in first.ravel()], object).reshape(first.shape)
    label = rows.schema["label"].dataType.simpleString()
    trees = stored(rows.mapInArrow(
        _chunks(scale, parts, chunk), f"ids binary, labels array<{label}>, x binary, orders binary, nodes binary, radius binary"), "cover-trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_moved(books), "part int, entry int, pos int, n long, total string")
        # One row per component of the codebooks comes back.
        for r in sums.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            books[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return trees, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()


def decode(code: str, books: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    step = 2 if books.shape[1] <= 256 else 4
    return [int(v) for p in range(len(books)) for v in books[p, int(code[p * step : p * step + step], 16)]]


def compress(embeddings: DataFrame, **parameters) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every vector, and the codebooks."""
    trees, books = train(embeddings, **parameters)
    label = embeddings.schema["label"].dataType.simpleString()
    if trees is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), None
    return trees.mapInArrow(*_coded(books, label)), books


def report(embeddings: DataFrame, **parameters) -> DataFrame:
    """Codes with their errors, the error of all vectors of a label, and the digest of the codebooks."""
    coded, books = compress(embeddings, **parameters)
    coded = stored(coded, "codes")
    most = F.lit(LONGEST_LONG).cast("decimal(38,0)")
    by_label = stored(coded.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label-errors")
    return coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).alias("codebooks_sha256"))
