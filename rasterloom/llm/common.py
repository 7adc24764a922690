"""Helpers that the operators on training text share.

Words are the runs of characters outside ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split()``
gives for UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.functions.ship import ship_package

MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
WORD_CACHE = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the caller's table does not use."""
    while name in df.columns:
        name += "_"
    return name


def repeated_ids(df: DataFrame, key: str) -> bool:
    """True when two rows share a key; reads the key column only, one row comes back."""
    return not df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).isEmpty()


def one_row_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each key; rows without a key stay.

    Rows that repeat a key are one record: the one with the least value counts (null only if all
    are null, then the least row). Nothing is shuffled where the key is unique already.
    """
    if not repeated_ids(df, key):
        return df
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(F.col(value).isNull(), F.col(value), F.to_json(row))
    least = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(row, order).alias("_row"))
    return least.select("_row.*").unionByName(df.filter(F.col(key).isNull()))


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The UTF-8 bytes of a text column, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary())


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The texts of a batch one by one; null is empty."""
    for value in binary(batch.column(column)):
        yield value.as_py() or b""


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, in order; empty when there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, seed, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = total * factor + words[i : i + count]
        return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of complete groups from a partition sorted by ``keys``; the last group of a batch waits for its rest."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = group_starts(batch, *keys)
        if waiting and all(batch.column(k)[0] == waiting[-1].column(k)[0] for k in keys) and len(starts) == 1:
            waiting.append(batch)
            continue
        cut = int(starts[-1])
        if waiting and not all(batch.column(k)[0] == waiting[-1].column(k)[0] for k in keys) and cut == 0:
            yield pa.Table.from_batches(waiting)
            waiting = [batch]
            continue
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
        waiting = [batch.slice(cut)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def group_starts(rows: pa.RecordBatch | pa.Table, *keys: str) -> np.ndarray:
    """Row numbers at which a new group begins."""
    n = rows.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        column = rows.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        differs = pc.not_equal(column.slice(0, n - 1), column.slice(1)).fill_null(True)
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def flat(table_: pa.Table | pa.RecordBatch, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list or fixed binary column."""
    values = table_.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
        wide = pa.types.is_large_binary(values.type)
        offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
        size = np.dtype(kind).itemsize
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.empty(0, np.uint8)
        return np.frombuffer(data.tobytes(), kind), (offsets.astype(np.int64) - int(offsets[0])) // size
    offsets = values.offsets.to_numpy().astype(np.int64)
    return values.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)`` as (node, component), the smallest node of each.

    Alternates two contractions: every node hands its larger neighbours to its least neighbour,
    then its smaller ones. Hubs stay cheap, since only joins on the node (which may be split) and
    pre-aggregated minima are shuffled. Each step is a written table, so lost executors cost at
    most one step. Self-links are allowed; nodes without any link have no row.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        pairs = both(edges)
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = stored(small.filter("u <> v").distinct(), name)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        edges, seen = small, now
    stars = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

