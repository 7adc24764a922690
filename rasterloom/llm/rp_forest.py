"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits the vectors of a label at the median of a random direction, again and again. Vectors within a
margin of the median go to both sides (spill), so that a similar pair is rarely cut; the margin follows from the
similarity asked for. Pairs are compared exactly within leaves only, and the pairs of all trees are united.

Nodes of more than ``NODE`` vectors are split on Spark, level by level (projections, an approximate median per
node, one table per level). Smaller nodes are split down to their leaves inside a task. A node that does not
shrink, because its vectors are all alike, is compared whole, in pairs of blocks.
Equal vectors of a label are one vector with a count from the start, so copies are never paired.

Vectors that are null, zero, hold null or non-finite components or have no label link with nothing: they are kept, alone. Only
vectors of equal length are compared. Rows that repeat a ``vec_id`` are one vector (the least); rows without
one take no part and are kept with a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import dimension_join, stored
from rasterloom.llm.common import components, group_starts, one_row_per_id, shuffle_partitions, whole_groups
from rasterloom.llm.jaccard_join import _clusters, in_blocks

THRESHOLD, TREES = 0.93, 6
NODE, LEAF = 8192, 256
# Margin in standard deviations of the projected difference of a pair at the threshold; a pair is cut
# only if it differs by more than twice the margin.
SPILL = 0.75
SHRINK = 0.85
FOUND = "u long, v long, u_size long, v_size long, star boolean"


def usable(vector: str) -> F.Column:
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def directions(seed: list[int], dim: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(dim) / np.sqrt(dim)


def margin(dim: int, threshold: float) -> float:
    return SPILL * np.sqrt(2 * (1 - threshold) / dim)


def matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The vectors of rows with the same dimension, in double precision."""
    column = rows.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaves(x: np.ndarray, seed: list[int], spill: float, leaf: int):
    """Row numbers of every leaf of one tree over ``x`` (unit vectors)."""
    waiting = [(np.arange(len(x)), 0, 0)]
    while waiting:
        rows, level, path = waiting.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        for attempt in range(3):
            at = x[rows] @ directions([*seed, level, path % (1 << 31), attempt], x.shape[1])
            middle = np.median(at)
            left, right = rows[at <= middle + spill], rows[at >= middle - spill]
            if max(len(left), len(right)) <= SHRINK * len(rows):
                waiting += [(left, level + 1, 2 * path + 1), (right, level + 1, 2 * path + 2)]
                break
        else:
            yield rows


def _compare(threshold: float, leaf: int):
    """Links within the leaves of each node, and stars that connect the same vectors."""

    def run(batches):
        for rows in whole_groups(batches, "tree", "node", "a", "b"):
            rows = rows.combine_chunks()
            starts = group_starts(rows, "tree", "node", "a", "b")
            for start, end in zip(starts, [*starts[1:], rows.num_rows]):
                node = rows.slice(start, end - start)
                if len(node) < 2:
                    continue
                rep, size = node.column("rep").to_numpy(), node.column("size").to_numpy()
                x = unit(matrix(node))
                linked = np.zeros((len(x), len(x)), bool)
                dense = node.column("dense")[0].as_py()
                seed = [node.column("tree")[0].as_py(), node.column("node")[0].as_py() & 0x7FFFFFFF]
                for some in [np.arange(len(x))] if dense else leaves(x, seed, margin(x.shape[1], threshold), leaf):
                    for at in range(0, len(some), 1024):
                        part = some[at : at + 1024]
                        linked[np.ix_(part, some)] |= x[part] @ x[some].T >= threshold
                np.fill_diagonal(linked, False)
                linked |= linked.T
                some = np.flatnonzero(linked.any(1))
                if not len(some):
                    continue
                some = some[np.argsort(rep[some])]
                linked, rep, size = linked[np.ix_(some, some)], rep[some], size[some]
                head = _clusters(linked)
                for at in range(0, len(some), 256):
                    i, j = np.nonzero(np.triu(linked[at : at + 256], at + 1))
                    yield _found(rep[at + i], rep[j], size[at + i], size[j], False)
                star = head != np.arange(len(head))
                yield _found(rep[head[star]], rep[star], size[head[star]], size[star], True)

    return run


def _found(u, v, u_size, v_size, star: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "u": pa.array(u), "v": pa.array(v), "u_size": pa.array(u_size), "v_size": pa.array(v_size),
        "star": pa.array(np.full(len(u), star))})


def _keyed(batches):
    """Adds a 128-bit digest of each vector."""
    for batch in batches:
        keys = [xxhash.xxh3_128_digest(np.asarray(v.values.to_numpy(zero_copy_only=False) + 0.0).tobytes()) for v in batch.column("vector")]
        both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
        yield batch.append_column("k1", pa.array(both[:, 0])).append_column("k2", pa.array(both[:, 1]))


def _projected(level: int):
    def run(batches):
        for batch in batches:
            tree, dim = batch.column("tree").to_numpy(), batch.column("dim").to_numpy()
            at = np.zeros(batch.num_rows)
            for t, d in {*zip(tree.tolist(), dim.tolist())}:
                rows = np.flatnonzero((tree == t) & (dim == d))
                at[rows] = unit(matrix(batch.take(pa.array(rows)))) @ directions([t, level, 1 << 20], d)
            yield batch.append_column("at", pa.array(at))

    return run


def grown(vectors: DataFrame, trees: int, threshold: float, node: int) -> DataFrame:
    """(tree, node, rep, size, vector, dim, n, dense): nodes of at most ``node`` vectors, and dense ones.

    ``n`` counts a node's vectors. Each round splits the nodes that are too large, all trees at once.
    """
    first = vectors.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "node", F.xxhash64("label", "dim"))
    columns = ["tree", "node", "rep", "size", "vector", "dim"]

    def counted(rows):
        n = stored(rows.groupBy("tree", "node").agg(F.count("*").alias("n")), "nodes")
        return dimension_join(rows, n, ["tree", "node"], F.col("rep"))

    open_ = stored(counted(first.select(*columns)), "forest")
    done = open_.filter(F.col("n") <= node).withColumn("dense", F.lit(False))
    open_ = open_.filter(F.col("n") > node)
    level = 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema)
    while not open_.isEmpty():
        placed = stored(open_.mapInArrow(_projected(level), schema + ", at double"), "projected")
        middle = stored(placed.groupBy("tree", "node").agg(F.percentile_approx("at", 0.5, 1000).alias("middle")), "medians")
        placed = dimension_join(placed, middle, ["tree", "node"], F.col("rep"))
        spill = F.lit(margin(1, threshold)) / F.sqrt("dim")
        side = F.array_compact(F.array(
            F.when(F.col("at") <= F.col("middle") + spill, F.lit(0)), F.when(F.col("at") >= F.col("middle") - spill, F.lit(1))))
        child = placed.withColumn("side", F.explode(side)).select(
            "tree", F.col("node").alias("parent"), "n", F.xxhash64("node", "side").alias("node"), "rep", "size", "vector", "dim")
        child = stored(child, "children")
        sizes = child.groupBy("tree", "parent", "node").agg(F.count("*").alias("c"), F.first("n").alias("of"))
        stuck = stored(sizes.groupBy("tree", "parent").agg((F.max(F.col("c") / F.col("of")) > SHRINK).alias("stuck")), "stuck")
        child = dimension_join(child, stuck, ["tree", "parent"], F.col("rep"))
        kept = counted(child.filter("not stuck").select(*columns))
        kept = stored(kept, "forest")
        whole = dimension_join(placed, stuck.withColumnRenamed("parent", "node"), ["tree", "node"], F.col("rep"))
        done = done.unionByName(kept.filter(F.col("n") <= node).withColumn("dense", F.lit(False)))
        done = done.unionByName(whole.filter("stuck").select(*columns, "n").withColumn("dense", F.lit(True)))
        open_, level = kept.filter(F.col("n") > node), level + 1
    return done


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, node: int = NODE, leaf: int = LEAF
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector."""
    rows = one_row_per_id(embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label"), "vec_id", "vector")
    valid = usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    kind = embeddings.schema["label"].dataType.simpleString()
    vector = rows.schema["vector"].dataType.simpleString()
    hashed = rows.filter(valid).mapInArrow(_keyed, f"vec_id long, vector {vector}, label {kind}, k1 long, k2 long")
    hashed = stored(hashed.withColumn("dim", F.size("vector")), "vectors")
    classes = stored(hashed.groupBy("label", "dim", "k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = hashed.join(classes.select(F.col("rep").alias("vec_id"), "size"), "vec_id").select(
        F.col("vec_id").alias("rep"), "size", "vector", "label", "dim")

    nodes = in_blocks(grown(reps, trees, threshold, node), F.when(F.col("dense"), F.col("n")).otherwise(1), "rep", node // 2)
    nodes = nodes.select("tree", "node", "a", "b", "dense", "rep", "size", "vector")
    nodes = nodes.repartition(shuffle_partitions(embeddings), "tree", "node", "a", "b").sortWithinPartitions("tree", "node", "a", "b", "rep")
    found = stored(nodes.mapInArrow(_compare(threshold, leaf), FOUND), "links")
    links = found.filter("not star").distinct()
    ends = links.select(F.col("u").alias("rep"), F.col("v_size").alias("more")).unionByName(
        links.select(F.col("v").alias("rep"), F.col("u_size").alias("more")))
    counted = ends.groupBy("rep").agg(F.sum("more").alias("links"))
    joined = components(found.filter("star").select("u", "v"), "joined")
    of = classes.join(counted, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "dim", "k1", "k2", F.coalesce("component", "rep").alias("component_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = hashed.join(of, ["label", "dim", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
