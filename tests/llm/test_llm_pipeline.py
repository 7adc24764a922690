"""The pipeline's stages, one after the other, against their operators on a small table."""

import collections

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F
from rasterloom.llm import segmentation


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").select("doc_id").collect()}
            kept = {r[0] for r in docs.select("doc_id").collect()}
            assert len(toxic - kept) <= 0.05 * len(toxic)
        if name == "line dedup":
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            texts = [tuple(r[0].split()) for r in docs.select("text").collect() if r[0] and r[0].split()]
            assert max(collections.Counter(texts).values()) == 1
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]
    pieces = segmentation.Pieces()
    texts = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
    for r in docs.collect():
        assert pieces.decode(r["ids"]).decode() == (texts[r["doc_id"]] or "")


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables pass through every stage."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", " \n\t", "one two three", "x" * 50_000, "word " * 5_000])]
    rows += [rows[3], (None, None, None, None, None), (None, "no number here", None, None, 2), (40, "one two three", None, "s", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for c in ("_toxicity", "_keep_bitmap", "_mix_source", "_mix_again", "score"):
        odd = odd.withColumn(c, F.lit("own"))
    docs = given.limit(60).unionByName(odd, allowMissingColumns=True).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.count() > 0
        assert {r[0] for r in docs.select("_toxicity").distinct().collect()} <= {"own", None}
        assert stage(spark, before.filter("false"), SF).isEmpty(), name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), SF).isEmpty()


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
