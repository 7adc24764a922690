"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target: a share of ``share`` times all tokens by weight, never more than ``limit``
times its own tokens; what is above is shared again among the others. A target of t times the
source takes every document floor(t) times whole and one more time those whose hash lies below the source's
threshold. Thresholds come from histograms: tokens are summed by source and leading hash bits, the
bucket that crosses the budget is refined by the next bits (only its documents are looked at again), and so
on until one document stands at the boundary. Documents are then filtered by their hash; nothing is sorted.

A hash is taken from ``doc_id`` by MD5, so reruns agree, and rows with equal ``doc_id`` are taken together.
A null or empty text has size 0 and is never taken. A null source is a source of its own, the last one; rows
without a ``doc_id`` share one hash. A source of no tokens has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import free_name, shuffle_partitions

WEIGHTS = (5, 2, 1)
# Bits of one histogram, and how many of them a hash holds.
BITS, LEVELS = 12, 5


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(key: str) -> Column:
    """60 bits of the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0: by code point, null last.

    Ranges of names are counted one by one and their totals summed up (one row per range), so the
    names never meet in one task.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    parts = stored(
        sources.repartitionByRange(shuffle_partitions(sources), *order)
        .withColumn("part", F.spark_partition_id()), "sources")
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("c")).select(
        "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("own", own).join(F.broadcast(starts), "part").withColumn(
        "rank", F.col("start") + F.col("own") - 1).drop("part", "own", "start")


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``.

    The level, tokens per weight, is raised until no source is above its limit; every step is one
    aggregate over the table of sources, whose two sums come back to the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked(sums).select("source", "source_size", weight.alias("weight")), "targets")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    cap, level = F.col("source_size") * F.lit(float(limit)), 0.0
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        held, left = table.agg(
            F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not left:
            break
        rest = total - held
        if rest <= level * left * (1 + 1e-12):
            break
        level = rest / left
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, fold, threshold): documents are taken ``fold`` times, and once more below ``threshold``.

    Each level sums tokens by source and hash bucket. ``low`` is the start of the bucket that crosses the
    budget; the tokens below it are spent. Only documents of that bucket go to the next level.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Rounding of the division must not cost a whole fold.
    fold = F.floor(ratio + 1e-9).cast("long")
    open_ = stored(goals.withColumn("fold", fold).select(
        "source", "fold", (F.col("target") - F.col("fold") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("low")), "budgets")
    rest = sizes.filter("size > 0").select("source", "size", "hash")
    for level in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - level))
        bucket = F.shiftright("hash", BITS * (LEVELS - 1 - level))
        histogram = rest.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = histogram.withColumn("up_to", F.sum("tokens").over(running))
        met = summed.alias("h").join(open_.alias("o"), F.col("h.source").eqNullSafe(F.col("o.source")))
        # The first bucket that does not fit whole; a source without one takes all that is left.
        crossing = met.filter("up_to > budget").groupBy(F.col("o.source").alias("source")).agg(
            F.min_by(F.struct("bucket", (F.col("up_to") - F.col("tokens")).alias("spent")), "bucket").alias("at"))
        open_ = stored(open_.alias("o").join(
            crossing.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")), "left"
        ).select(
            "o.source", "fold",
            F.when(F.col("at").isNull(), F.col("budget")).otherwise(F.col("budget") - F.col("at.spent")).alias("budget"),
            F.when(F.col("at").isNull(), F.col("low") if level else F.lit(1 << (BITS * LEVELS)))
            .otherwise(F.col("at.bucket") * F.lit(width)).cast("long").alias("low"),
        ), "budgets")
        if level == LEVELS - 1:
            break
        rest = stored(rest.alias("r").join(
            open_.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))
            & (F.shiftright("r.hash", BITS * (LEVELS - 1 - level)) == F.shiftright("o.low", BITS * (LEVELS - 1 - level)))
        ).select("r.source", "size", "hash"), "boundary")
        several = rest.groupBy("source").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).filter("a < b")
        if several.isEmpty():
            break
    return open_.select("source", "fold", F.col("low").alias("threshold"))


def plan(docs: DataFrame, share: float, limit: float, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents, and per source its size, target, fold and threshold."""
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size"), hash60("doc_id").alias("hash")), "sizes")
    goals = stored(targets(sizes, share, limit, weights), "goals")
    of = goals.alias("g").join(thresholds(sizes, goals).alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")))
    return sizes, stored(of.select("g.source", "source_size", "target", "fold", "threshold"), "mix")


def mix_report(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (tokens, repeats counted)."""
    sizes, of = plan(docs, share, limit, weights)
    times = F.when(F.col("size") > 0, F.col("fold") + (F.col("hash") < F.col("threshold")).cast("long")).otherwise(0)
    return sizes.alias("s").join(of.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All rows and columns, each row as often as the mix takes it; rows of no tokens once, as they cost nothing."""
    _, of = plan(docs, share, limit, weights)
    name, fold, below, again = (free_name(docs, f"_mix_{c}") for c in ("source", "fold", "below", "again"))
    of = of.select(F.col("source").alias(name), F.col("fold").alias(fold), F.col("threshold").alias(below))
    more = (hash60("doc_id") < F.col(below)).cast("int")
    times = F.when(word_count() > 0, F.col(fold).cast("int") + more).otherwise(F.lit(1))
    return (
        docs.join(of, F.col("source").eqNullSafe(F.col(name)))
        .withColumn(again, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
    )
