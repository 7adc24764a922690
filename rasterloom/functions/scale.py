"""Helpers that keep a plan safe when one key holds a large share of the rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Positions per block of a long ordered list. One block of one key is the most that a
# single window partition ever sees.
BLOCK_ROWS = 1 << 18

# A dimension with at most this many rows may be broadcast.
BROADCAST_ROWS = 20_000

# Least copies of the unhinted side when a dimension is too large to broadcast.
SALTS = 32


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    value: Column,
    out: str,
    agg: str = "sum",
    inclusive: bool = False,
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` per key, without one task per key.

    ``block`` must not decrease along ``order``. Each block is reduced first (map-side
    combine), the short list of block totals is accumulated per key, and the window over the
    rows sees one block of one key at a time. Keys that fit in one block need no totals, so
    the join side is empty for them. Rows before the first one give 0 for sums and null for max.
    """
    fold = {"sum": F.sum, "max": F.max}[agg]
    before_me = (Window.unboundedPreceding, 0 if inclusive else -1)
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    totals = blocked.groupBy(*keys, "_block").agg(fold("_value").alias("_total"))
    carried = (
        totals.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_block").alias("_kb"),
            fold("_total")
            .over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry"),
        )
        .filter(F.col("_carry").isNotNull())
    )
    local = blocked.withColumn(
        "_local",
        fold("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(*before_me)),
    )
    on = F.col("_block").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, on, "left")
    if agg == "sum":
        total = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        total = F.greatest("_local", "_carry")
    return joined.withColumn(out, total).drop(
        "_block", "_value", "_local", "_carry", "_kb", *[f"_k{i}" for i in range(len(keys))]
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """1-based position of each row in its key's list (see :func:`running`)."""
    return running(df, keys, order, block, F.lit(1).cast("bigint"), out, inclusive=True)


def numbered_once(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """As :func:`numbered`, for tables whose rows should be shuffled once: the totals before a block are its first row, not a join.

    A join on keys that may be null deals the rows anew where the totals are too many to broadcast.
    """
    blocked = df.withColumn("_block", block)
    up_to = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    carried = totals.withColumn("_carry", F.sum("_n").over(up_to)).filter("_carry is not null").drop("_n")
    rows = blocked.withColumn("_carry", F.lit(None).cast("bigint")).unionByName(carried, allowMissingColumns=True)
    in_block = Window.partitionBy(*keys, "_block").orderBy(F.col("_carry").desc_nulls_last(), *order)
    position = F.sum(F.coalesce("_carry", F.lit(1).cast("bigint"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, position).filter("_carry is null").select(*df.columns, out)


def by_key(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition for work that costs far more time than its bytes suggest.

    The number is the session's shuffle partitions, given explicitly so that adaptive execution
    does not merge small but slow partitions into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def pos_block(col: str = "pos", rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(col) / F.lit(rows))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the dimension has at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def dimension_join(
    facts: DataFrame, dim: DataFrame, keys: list[str], spread: Column, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Inner join of a fact table with a dimension on few, hot keys.

    A dimension of checked size is broadcast. A larger one is copied over salts, as many as a shuffle
    has partitions (``SALTS`` at least), and the facts are spread over the same salts by ``spread``, so that one hot key is
    cut up and all tasks have work.
    """
    if is_small(dim, max_rows):
        return facts.join(F.broadcast(dim), keys)
    salts = max(SALTS, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(salted_dim, [*keys, "_salt"]).drop("_salt")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (see :func:`checkpoint_root`)."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


_MADE: dict[str, list[str]] = {}


def clean_work(spark: SparkSession) -> None:
    """Delete the folders this application made; results that still read from them must be done."""
    for folder in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir``, else the folder the context already has, else one below the
    session's warehouse. That last one is refused where it lies on a local disk while the
    executors run on other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        refuse_local(root, spark.sparkContext.master)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def refuse_local(folder: str, master: str) -> None:
    """Raise where ``folder`` is on this machine's disk but the executors may be elsewhere."""
    if not re.match(r"local(\[.*\])?$", master) and folder.startswith("file:"):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; {folder} is on one machine only")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage like a checkpoint, and the known file size lets Spark choose a broadcast
    join only where the table really is small. ``codec`` other than the session's is for large tables.
    """
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage with a reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
