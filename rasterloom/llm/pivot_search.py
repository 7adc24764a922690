"""Exact top-k search by inner product, with a pivot table that eliminates candidates.

Components become integers (floor of ``SCALE`` times the component). With one more coordinate that brings every
candidate to the same length R, the inner product of query q and candidate x is
(|q|^2 + R^2 - d(q, x)^2) / 2, so the largest product has the least distance. Distances of all vectors to many pivots are
computed once; |d(q, p) - d(x, p)| is a lower bound of d(q, x) for every pivot p, and its maximum over the pivots the bound used.
Candidates of a block are evaluated in the order of their bounds until the next bound cannot beat the k-th best product found; the
rest is eliminated unseen. Products are exact integers.

Queries and candidates meet in blocks: every block of queries visits every block of candidates, and each visit
gives at most k rows per query, of which the k best are kept. Pivots are a fixed number of vectors.

Vectors that are null or hold null or non-finite components take no part, nor do rows without a ``vec_id``. Rows that repeat a
``vec_id`` are one vector (the least). Vectors of different length are not compared. Ties go to the smaller
``vec_id``. Products are exact for components of any size: in doubles while sums stay below 2^53, in 64 bits below 2^62, in
whole numbers of any length beyond. They are ranked in 38 digits; scores beyond a long are returned as the nearest long.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import one_row_per_id, shuffle_partitions

SCALE, K, PIVOTS = 256, 5, 32
# Rows of a block of queries and of candidates; vectors among which the pivots are chosen.
QUERY_BLOCK, CANDIDATE_BLOCK, PIVOT_SAMPLE = 512, 2048, 2048
FOUND = "query_id long, vec_id long, score decimal(38,0)"
LONG = (1 << 63) - 1
# Products in a decimal; larger ones count as this.
WIDEST = 10**38 - 1


def finite(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def _integers(scale: float):
    """(vec_id, dim, v): whole components, held in doubles."""

    def run(batches):
        for batch in batches:
            rows = [np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale) for x in batch.column("embedding")]
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "dim": pa.array([len(r) for r in rows], pa.int32()),
                "v": pa.array([r.tobytes() for r in rows], pa.binary())})

    return run


def chosen_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart vectors: each is the one farthest from those chosen before."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors with the extra coordinate ``lift`` to pivots without one."""
    squares = (x**2).sum(1)[:, None] + lift[:, None] ** 2 + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _packed(pivots: dict[int, np.ndarray], radius: dict[int, float], lifted: bool):
    """One row per block: its numbers, vectors and pivot distances."""

    def run(batches):
        for batch in batches:
            for dim, block, ids, vectors in zip(*(batch.column(c) for c in ("dim", "block", "ids", "vectors"))):
                dim = dim.as_py()
                ids = ids.values.to_numpy()
                x = np.frombuffer(b"".join(vectors.as_py()), np.float64).reshape(len(ids), dim)
                order = np.argsort(ids)
                ids, x = ids[order], x[order]
                lift = np.sqrt(np.maximum(radius[dim] - (x**2).sum(1), 0)) if lifted else np.zeros(len(x))
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim], pa.int32()), "block": pa.array([block.as_py()], pa.int32()),
                    "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()),
                    "table": pa.array([distances(x, lift, pivots[dim]).tobytes()], pa.binary())})

    return run


PACKED = "dim int, block int, ids binary, x binary, table binary"


def best_of_block(q: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: np.ndarray, own: int, radius: float, k: int, step: int = 256):
    """The k best (score, id) of a block for one query, and how many candidates were evaluated."""
    bound = np.abs(x_table - q_table).max(1)
    order = np.argsort(bound, kind="stable")
    # Largest product that a bound leaves possible, with room for rounding.
    length = float((q * q).sum())
    possible = (length + radius - bound[order] ** 2) / 2
    possible += 1e-6 * (1 + length + radius)
    scores, numbers = np.empty(0, object if x.dtype == object else np.int64), np.empty(0, np.int64)
    seen = 0
    while seen < len(order):
        if len(scores) == k and possible[seen] < scores[-1]:
            break
        at = order[seen : seen + step]
        at = at[ids[at] != own]
        scores, numbers = np.concatenate([scores, (x[at] @ q).astype(scores.dtype)]), np.concatenate([numbers, ids[at]])
        by_number = np.argsort(numbers, kind="stable")
        best = by_number[np.argsort(-scores[by_number], kind="stable")][:k]
        scores, numbers, seen = scores[best], numbers[best], seen + step
    return scores, numbers, min(seen, len(order))


def whole(x: np.ndarray, bound: float) -> np.ndarray:
    """Whole numbers held in doubles, as a type in which sums below ``bound`` are exact; doubles are fastest."""
    if bound < 2.0**53:
        return x
    if bound < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _visited(radius: dict[int, float], k: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)
                dim = batch.column("dim")[row].as_py()
                ids, q_ids = get("ids", np.int64), get("q_ids", np.int64)
                x, q = (get(c, np.float64).reshape(n, dim) for c, n in (("x", len(ids)), ("q_x", len(q_ids))))
                bound = dim * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
                x, q = whole(x, bound), whole(q, bound)
                table = get("table", np.float64).reshape(len(ids), -1)
                q_table = get("q_table", np.float64).reshape(len(q_ids), -1)
                out = [best_of_block(q[i], q_table[i], x, table, ids, q_ids[i], radius[dim], k)[:2] for i in range(len(q_ids))]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(q_ids, [len(s) for s, _ in out])),
                    "vec_id": pa.array(np.concatenate([n for _, n in out])),
                    "score": pa.array([Decimal(max(-WIDEST, min(WIDEST, int(v)))) for s, _ in out for v in s], pa.decimal128(38, 0))})

    return run


def search(embeddings: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products of every query with all other vectors."""
    rows = one_row_per_id(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vec_id", "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & finite("embedding"))
    ints = stored(rows.mapInArrow(_integers(scale), "vec_id long, dim int, v binary"), "integers")
    counts = {r["dim"]: r["n"] for r in ints.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    points, radius = {}, {}
    for dim, n in counts.items():  # as many as there are different lengths
        some = ints.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
        sample = np.array([np.frombuffer(r["v"], np.float64) for r in some]).reshape(len(some), dim)
        points[dim] = chosen_pivots(sample, pivots)
        radius[dim] = _longest(ints.filter(F.col("dim") == dim))

    def number(of, size):
        return F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // size))) for d, n in of.items()], F.lit(1))

    def blocks(df, of, size, lifted):
        # Blocks are dealt by hash; their number follows the rows, so a block has about ``size`` of them.
        pick = number(of, size)
        df = df.withColumn("block", F.pmod(F.xxhash64("vec_id"), pick).cast("int"))
        df = df.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
        df = df.select("dim", "block", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vectors"))
        return stored(df.mapInArrow(_packed(points, radius, lifted), PACKED), "blocks")

    asked = {r["dim"]: r["n"] for r in ints.filter(is_query).groupBy("dim").agg(F.count("*").alias("n")).collect()}
    candidates = blocks(ints, counts, CANDIDATE_BLOCK, True)
    queries = blocks(ints.filter(is_query), asked, QUERY_BLOCK, False).select(
        "dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "x", "table")])
    # Each block of queries travels to the candidate blocks of its dimension, named one by one; those move once.
    tasks = shuffle_partitions(embeddings)
    visits = queries.withColumn("block", F.explode(F.sequence(F.lit(0), number(counts, CANDIDATE_BLOCK) - 1)))
    met = visits.repartition(tasks, "dim", "block").join(candidates.repartition(tasks, "dim", "block"), ["dim", "block"])
    found = met.mapInArrow(_visited(radius, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.greatest(F.lit(-LONG - 1).cast("decimal(38,0)"), F.least(F.lit(LONG).cast("decimal(38,0)"), F.col("score"))).cast("long")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score.alias("score"))


def _longest(ints: DataFrame) -> float:
    """Largest squared length of the vectors of one dimension."""

    def run(batches):
        for batch in batches:
            squares = [float((np.frombuffer(v.as_py(), np.float64) ** 2).sum()) for v in batch.column("v")]
            yield pa.RecordBatch.from_pydict({"square": pa.array([max(squares, default=0.0)], pa.float64())})

    return ints.select("v").mapInArrow(run, "square double").agg(F.max("square")).first()[0] or 0.0
