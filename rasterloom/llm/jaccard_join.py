"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles (five words; a shorter text is one shingle). Two texts link when
the Jaccard similarity of their sets is at least ``THRESHOLD``. Equal sets are one class from the start,
so copies are never paired with each other. The way:

1. MinHash values of every set (one pass), one row per class of equal sets.
2. Classes that share a band of values are candidates. In each such bucket they are compared on
   their values step by step; a pair goes as soon as the posterior probability of reaching the
   threshold is below ``TOLERANCE``. What stays is joined into candidate clusters as stars, never as
   all pairs.
3. Each cluster meets once: its pairs are pruned the same way, the rest is verified exactly
   on the shingle sets. Links are counted, not listed; a star of links per block goes on.
4. Connected components of the links are the classes.

Large buckets and clusters are cut into blocks and every pair of blocks is compared, so no group has
to fit into a task. A pair at the threshold is missed by all bands with a probability of 5e-5, more similar
ones far less often.

Null and empty texts have no shingle and link with nothing. Rows that repeat a ``doc_id`` are one
document (the least text); rows without a ``doc_id`` take no part: their class is null, they have no links.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import (
    WordHashes, components, flat, gram_hashes, group_starts, mixed, one_row_per_id, shuffle_partitions, signed, texts,
    whole_groups,
)

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 25, 5
VALUES = 128
# Values compared in the pruning steps (16 bits each; equal low bits by chance only keep a pair longer).
COMPARED, STEP = 64, 16
BUCKET_BLOCK, CLUSTER_BLOCK = 4096, 1024

_FACTORS = (np.random.default_rng(7).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def shingle_set(raw: bytes, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = raw.split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words), min(n, len(words)), min(n, len(words))))


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            np.minimum(least, (_FACTORS * shingles[None, i : i + 1024]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fewest_equal(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Least number of equal values among ``n`` with P(similarity >= threshold) >= tolerance, for a uniform prior."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


NEEDED = [fewest_equal(n) for n in range(STEP, COMPARED + 1, STEP)]


def _signatures(batches):
    hashes = WordHashes()
    for batch in batches:
        keys, sizes, values = [], [], []
        for raw in texts(batch, "text"):
            shingles = shingle_set(raw, hashes)
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            sizes.append(len(shingles))
            values.append(minhash(shingles).tobytes() if len(shingles) else b"")
        both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "k1": pa.array(both[:, 0]), "k2": pa.array(both[:, 1]),
            "n": pa.array(sizes, pa.int32()), "sig": pa.array(values, pa.binary())})


def _bands(batches):
    for batch in batches:
        values = flat(batch, "sig", np.uint32)[0].reshape(-1, VALUES).astype(np.uint64)
        out = np.empty((batch.num_rows, BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                total = np.full(batch.num_rows, b, np.uint64)
                for r in range(ROWS):
                    total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + values[:, b * ROWS + r])
                out[:, b] = total
        yield pa.RecordBatch.from_pydict({
            "band": pa.array(signed(out.ravel())), "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))})


def _short(batches):
    """The values that the pruning steps compare."""
    for batch in batches:
        values = flat(batch, "sig", np.uint32)[0].reshape(-1, VALUES)[:, :COMPARED].astype(np.uint16)
        yield pa.RecordBatch.from_pydict({
            "rep": batch.column("rep"), "size": batch.column("size"),
            "short": pa.array([row.tobytes() for row in values], pa.binary())})


def in_blocks(df: DataFrame, count: Column, id_: str, block: int) -> DataFrame:
    """Adds ``a``, ``b``, ``left``: every row meets all rows of its group in pairs of blocks of about ``block`` rows.

    ``left`` tells whether the row is of block ``a``; groups of one block have a = b = 0.
    """
    blocks = F.ceil(count / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(id_), blocks).cast("int")
    return (
        df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
        .withColumn("left", F.col("own") == F.col("a")).drop("other", "own")
    )


def _alive(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` survive all steps against ``one`` (a row, or as many rows)."""
    alive = np.arange(len(many))
    equal = np.zeros(len(many), np.int64)
    for step, need in enumerate(NEEDED):
        part = slice(step * STEP, (step + 1) * STEP)
        left = one[alive, part] if one.ndim == 2 else one[part]
        equal = equal + (many[alive, part] == left).sum(1)
        stay = equal >= need
        alive, equal = alive[stay], equal[stay]
    return alive


def _stars(batches):
    """Candidate links of each bucket as stars: every surviving pair is connected by them."""
    for rows in whole_groups(batches, "band", "a", "b"):
        rows = rows.combine_chunks()
        rep = rows.column("rep").to_numpy()
        short = flat(rows, "short", np.uint16)[0].reshape(-1, COMPARED)
        starts = group_starts(rows, "band", "a", "b")
        lengths = np.diff([*starts, len(rep)])
        # First try: all rows of a bucket against its first one, at once.
        head = np.repeat(starts, lengths)
        joined = np.zeros(len(rep), bool)
        joined[_alive(short[head], short)] = True
        u, v = [rep[head][joined]], [rep[joined]]
        open_groups = np.add.reduceat(~joined, starts) > 0
        for start, length in zip(starts[open_groups], lengths[open_groups]):
            mine = np.arange(start, start + length)
            waiting, front = mine[~joined[mine]], list(mine[joined[mine]][1:])
            # Breadth first: whoever is connected looks once among those who are not yet.
            while len(waiting):
                if not front:
                    front, waiting = [waiting[0]], waiting[1:]
                at = front.pop()
                near = waiting[_alive(short[at], short[waiting])]
                if len(near):
                    u.append(np.full(len(near), rep[at]))
                    v.append(rep[near])
                    waiting = waiting[~np.isin(waiting, near)]
                    front.extend(near)
        u, v = np.concatenate(u), np.concatenate(v)
        keep = u != v
        yield pa.RecordBatch.from_pydict({"u": pa.array(u[keep]), "v": pa.array(v[keep])})


def _candidates(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Matrix of the pairs that survive the pruning steps."""
    equal = np.zeros((len(one), len(two)), np.uint8)
    alive = np.ones(equal.shape, bool)
    for step, need in enumerate(NEEDED):
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            break
        block = np.ix_(rows, columns)
        found = equal[block]
        for i in range(step * STEP, (step + 1) * STEP):
            found += one[rows, i][:, None] == two[columns, i][None, :]
        equal[block] = found
        alive[block] &= found >= need
    return alive


def _shared(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs (positions into ``rows`` x ``columns``)."""
    used = np.union1d(rows[np.unique(pairs[0])], columns[np.unique(pairs[1])])
    where = {int(x): i for i, x in enumerate(used)}
    lengths = [len(sets[i]) for i in used]
    vocabulary, code, seen = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    # A shingle of one text only adds nothing to any intersection.
    number = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)
    width = int((seen > 1).sum())
    left = np.array([where[int(x)] for x in rows[pairs[0]]])
    right = np.array([where[int(x)] for x in columns[pairs[1]]])
    column, row = number[code], np.repeat(np.arange(len(used)), lengths)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    if len(pairs[0]) < 64 or len(pairs[0]) * 5e-6 < len(used) ** 2 * width * 2e-11:
        by_row = np.split(column[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=len(used)))[:-1])
        return np.array([len(np.intersect1d(by_row[i], by_row[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    total = np.zeros((len(used), len(used)), np.float32)
    for start in range(0, width, 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(used), 2048), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def _clusters(linked: np.ndarray) -> np.ndarray:
    """Smallest position of each row's component in a symmetric adjacency matrix."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] >= 0:
            continue
        front = np.array([i])
        label[i] = i
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & (label < 0))
            label[front] = i
    return label


def _verify(threshold: float):
    """Exact links of each pair of blocks: summed class sizes per row, and stars of the links."""

    def run(batches):
        hashes = WordHashes()
        for tables in whole_groups(batches, "component", "a", "b"):
            tables = tables.combine_chunks()
            starts = group_starts(tables, "component", "a", "b")
            for start, end in zip(starts, [*starts[1:], tables.num_rows]):
                group = tables.slice(start, end - start)
                rep, size = group.column("rep").to_numpy(), group.column("size").to_numpy()
                order = np.argsort(rep)
                rep, size = rep[order], size[order]
                group = group.take(pa.array(order))
                short = flat(group, "short", np.uint16)[0].reshape(-1, COMPARED)
                left = group.column("left").to_numpy(zero_copy_only=False)
                same = group.column("a")[0] == group.column("b")[0]
                rows = np.arange(len(rep)) if same else np.flatnonzero(left)
                columns = rows if same else np.flatnonzero(~left)
                alive = _candidates(short[rows], short[columns])
                if same:
                    alive = np.triu(alive, 1)
                pairs = np.nonzero(alive)
                if not len(pairs[0]):
                    continue
                wanted = np.union1d(rows[pairs[0]], columns[pairs[1]])
                sets: list = [None] * len(rep)
                for i in wanted:
                    sets[i] = shingle_set(group.column("text")[int(i)].as_py().encode(), hashes)
                shared = _shared(sets, rows, columns, pairs)
                i, j = rows[pairs[0]], columns[pairs[1]]
                lengths = np.array([0 if x is None else len(x) for x in sets])
                ok = shared >= threshold * (lengths[i] + lengths[j] - shared) - 1e-9
                i, j = i[ok], j[ok]
                links = np.bincount(i, size[j], len(rep)) + np.bincount(j, size[i], len(rep))
                linked = np.zeros((len(rep), len(rep)), bool)
                linked[i, j] = linked[j, i] = True
                label = _clusters(linked)
                out = links > 0
                yield pa.RecordBatch.from_pydict({
                    "rep": pa.array(rep[out]), "links": pa.array(links[out].astype(np.int64)),
                    "leader": pa.array(rep[label][out])})

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): the smallest document reachable by links, and the number of documents linked directly."""
    rows = one_row_per_id(docs.select("doc_id", "text"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = rows.filter("doc_id is not null")
    hashed = stored(known.mapInArrow(_signatures, "doc_id long, k1 long, k2 long, n int, sig binary"), "signatures")
    classes = hashed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = stored(classes, "classes")
    reps = stored(hashed.select("doc_id", "sig").join(
        classes.select(F.col("rep").alias("doc_id"), "size"), "doc_id"
    ).withColumnRenamed("doc_id", "rep"), "reps")

    banded = reps.select("rep", "sig").mapInArrow(_bands, "band long, rep long")
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    short = reps.mapInArrow(_short, "rep long, size long, short binary")
    members = in_blocks(banded.join(shared, "band").join(short.select("rep", "short"), "rep"), F.col("c"), "rep", BUCKET_BLOCK)
    partitions = shuffle_partitions(docs)
    buckets = members.select("band", "a", "b", "rep", "short").repartition(partitions, "band", "a", "b")
    buckets = buckets.sortWithinPartitions("band", "a", "b", "rep")
    candidates = components(buckets.mapInArrow(_stars, "u long, v long"), "candidates")

    candidates = stored(candidates, "clusters")
    count = candidates.groupBy("component").agg(F.count("*").alias("c"))
    clusters = candidates.join(count, "component").withColumnRenamed("node", "rep").join(short, "rep")
    met = known.select(F.col("doc_id").alias("rep"), "text").join(clusters, "rep")
    met = in_blocks(met, F.col("c"), "rep", CLUSTER_BLOCK)
    met = met.select("component", "a", "b", "left", "rep", "size", "short", "text")
    met = met.repartition(partitions, "component", "a", "b").sortWithinPartitions("component", "a", "b")
    links = stored(met.mapInArrow(_verify(threshold), "rep long, links long, leader long"), "links")
    joined = components(links.select(F.col("rep").alias("u"), F.col("leader").alias("v")), "joined")

    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known_class = (
        classes.join(counted, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", F.coalesce("component", "rep").alias("class_id"),
                (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    full = hashed.select("doc_id", "k1", "k2", "n").join(known_class, ["k1", "k2"], "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    nameless = rows.filter("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(nameless)


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of one document of each class (the smallest ``doc_id``); rows without a ``doc_id`` stay."""
    docs = one_row_per_id(docs, "doc_id", "text")
    gone = jaccard_join(docs, threshold).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
