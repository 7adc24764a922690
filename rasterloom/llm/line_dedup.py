"""Line dedup: range-partitioned line hashes, streamed in order, give keep bitmaps per document.

A line's key is the line without blanks at its ends, with A-Z in lower case. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except
those in the largest document that holds the key.

128-bit key hashes are range-partitioned together with document and position, so a line that a
third of all documents share is spread over many ranges, and sorted within each range. A range is
streamed once: a key that lies inside it is decided on the spot. Only the first and the last key of
a range may go on in its neighbours; their parts are summed in a table of at most two rows per range.
The result of the search is a compressed bitmap per document, not text.

Null and empty texts are one empty line. Lines are split at ``\\n`` only. Rows that repeat a document
number are one document whose text is the least of theirs; rows without a number hold no copies,
keep all their lines and are returned as they are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import binary, free_name, group_starts, one_row_per_id, shuffle_partitions, texts


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip().lower() for line in text.split(b"\n")]


def _hashed(min_chars: int):
    """(h1, h2, doc, pos) of every line whose key is long enough."""

    def run(batches):
        for batch in batches:
            docs, hashes, at, counts = batch.column("doc_id").to_pylist(), [], [], []
            for raw in texts(batch, "text"):
                before = len(at)
                for i, key in enumerate(line_keys(raw)):
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        at.append(i)
                counts.append(len(at) - before)
            both = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "h1": pa.array(both[:, 0]), "h2": pa.array(both[:, 1]),
                "doc_id": pa.array(np.repeat(np.array(docs, np.int64), counts)), "pos": pa.array(at, pa.int32())})

    return run


def _stream(min_docs: int):
    """Lines to drop (``open`` false), and all lines of the first and the last key of a batch (``open``)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = group_starts(batch, "h1", "h2")
            doc = batch.column("doc_id").to_numpy()
            group = np.zeros(n, np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            new_doc = np.ones(n, bool)
            new_doc[1:] = (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])
            docs = np.bincount(group, new_doc)
            is_open = (group == 0) | (group == group[-1])
            drop = ~is_open & (docs[group] >= min_docs) & (doc != doc[starts][group])
            out = batch.filter(pa.array(is_open | drop))
            yield out.append_column("open", pa.array(is_open[is_open | drop]))

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, pos) of every line to drop; ``docs`` has one row per ``doc_id``."""
    lines = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(
        _hashed(min_chars), "h1 long, h2 long, doc_id long, pos int")
    order = ["h1", "h2", F.desc("doc_id"), "pos"]
    ranges = lines.repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    seen = stored(ranges.mapInArrow(_stream(min_docs), "h1 long, h2 long, doc_id long, pos int, open boolean"), "lines")
    edge = seen.filter("open")
    # Written, so that its size is known before the join and a common line's rows need not be shuffled.
    keys = stored(
        edge.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest")).filter(F.col("docs") >= min_docs), "edges")
    late = edge.join(keys, ["h1", "h2"]).filter("doc_id <> largest")
    return seen.filter("not open").select("doc_id", "pos").unionByName(late.select("doc_id", "pos"))


def pack(keep: np.ndarray) -> bytes:
    """A bitmap of one bit per line, compressed; lines beyond its end stay."""
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes | None, lines: int) -> np.ndarray:
    keep = np.ones(lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, bitmap) of the documents that lose lines; ``docs`` has one row per ``doc_id``."""

    def packed(batches):
        for batch in batches:
            bitmaps = []
            for at in batch.column("at"):
                at = at.values.to_numpy()
                keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
                keep[at] = False
                bitmaps.append(pack(keep))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bitmap": pa.array(bitmaps, pa.binary())})

    return (
        dropped_lines(docs, min_chars, min_docs).groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
        .mapInArrow(packed, "doc_id long, bitmap binary")
    )


def kept_lines(raw: bytes, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """The lines that stay, and the number of all lines."""
    lines = raw.split(b"\n")
    if not bitmap:
        return lines, len(lines)
    return [line for line, k in zip(lines, unpack(bitmap, len(lines))) if k], len(lines)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns, with ``text`` reduced to the lines that stay and ``n_chars``, if there, counted anew."""
    docs = one_row_per_id(docs, "doc_id", "text")
    held = free_name(docs, "_keep_bitmap")
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).withColumnRenamed("bitmap", held)

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([
            t if b is None else b"\n".join(kept_lines(t.encode("utf-8", "replace"), b)[0]).decode("utf-8", "replace")
            for t, b in zip(text, bitmap)], dtype=object)

    out = docs.join(bitmaps, "doc_id", "left").withColumn("text", kept("text", held)).drop(held)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of what stays."""
    docs = one_row_per_id(docs.select("doc_id", "text"), "doc_id", "text")

    def report(batches):
        for batch in batches:
            lines, dropped, digests = [], [], []
            for raw, bitmap in zip(texts(batch, "text"), binary(batch.column("bitmap")).to_pylist()):
                kept, n = kept_lines(raw, bitmap)
                lines.append(n)
                dropped.append(n - len(kept))
                digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_lines": pa.array(lines, pa.int64()),
                "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return docs.join(keep_bitmaps(docs, min_chars, min_docs), "doc_id", "left").mapInArrow(
        report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
