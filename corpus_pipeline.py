"""From raw documents to token ids: toxicity, line dedup, near duplicates, mixing, segmentation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and the next stage reads that. All stages but the last return the columns of documents. Each of them
handles null and empty texts, repeated rows and extra columns as its operator's docstring says.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rasterloom.functions.scale import stored  # noqa: E402
from rasterloom.llm import jaccard_join, line_dedup, mixing, segmentation, toxicity  # noqa: E402
from rasterloom.llm.common import free_name, table  # noqa: E402

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a third of the labels stays unseen, as in ``op10_toxicity``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    score = free_name(docs, "_toxicity")
    return docs.withColumn(score, toxicity.scored(F.col("text"), model)).filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents share stay in one of them only."""
    return line_dedup.line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The N best segmentations of every text."""
    return segmentation.encode(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

# The learned lexicon and the segmentation have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
