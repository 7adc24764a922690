"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (``FEATURES``) are cut into quantile bins; trees of fixed depth are grown on gradient
histograms and flattened into arrays, so that a batch passes all trees at once in numpy. The trees
are fitted on a bounded sample of labelled rows; every row is scored where it lies, nothing is shuffled.

Null and empty texts have the statistics of an empty text and a score like any other. Repeated rows and ties get equal
scores. Without labels of both classes every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import WordHashes, gram_hashes, texts

FEATURES = [
    "log_words", "word_length", "word_length_spread", "letters", "digits", "capitals", "marks", "odd_marks", "beyond_ascii",
    "different_words", "commonest_word", "repeated_pairs", "repeated_fives", "longest_repeat", "log_lines", "line_words",
    "repeated_lines", "capitalised_words", "marked_words", "words_without_letters", "one_letter_words", "full_stops",
    "byte_entropy", "compressed",
]
ROWS, BINS, TREES, DEPTH, RATE = 20_000, 64, 80, 4, 0.15
LEAST_ROWS, RIDGE = 20, 1.0

_LETTER, _DIGIT, _UPPER, _MARK, _ODD, _HIGH = (1 << i for i in range(6))


def _classes() -> np.ndarray:
    """Properties of every byte."""
    out = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        if c.isalpha():
            out[b] = _LETTER | (_UPPER if c.isupper() else 0)
        elif c.isdigit():
            out[b] = _DIGIT
        else:
            out[b] = _MARK | (0 if c in ".,;:'\"-?!()" else _ODD)
    out[128:] = _LETTER | _HIGH
    return out


_OF = _classes()
_PER = np.array([[bool(_OF[b] & bit) for b in range(256)] for bit in (_LETTER, _DIGIT, _UPPER, _MARK, _ODD, _HIGH)], np.float64)


def statistics(raw: bytes, hashes: WordHashes, squeeze: zstandard.ZstdCompressor) -> list[float]:
    """The values of ``FEATURES`` for a text."""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    data = np.frombuffer(raw, np.uint8)
    count = np.bincount(data, minlength=256).astype(np.float64)
    visible = max(1.0, count[33:].sum())
    letters, digits, upper, marks, odd, high = _PER @ count
    lengths = np.fromiter(map(len, words), np.int64, n)
    numbers = hashes.of(words)
    _, often = np.unique(numbers, return_counts=True)
    pairs, fives = gram_hashes(numbers, 2), gram_hashes(numbers, 5)
    changes = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True])
    lines = raw.split(b"\n")
    firsts = np.fromiter((w[0] for w in words), np.uint8, n)
    lasts = np.fromiter((w[-1] for w in words), np.uint8, n)
    blank = np.flatnonzero(np.r_[True, (data <= 32), True])
    has_letter = np.concatenate([[0], np.cumsum((_OF[data] & _LETTER) > 0)])
    spans = has_letter[np.minimum(blank[1:] - 1, len(data))] - has_letter[np.minimum(blank[:-1], len(data))]
    lettered = int((spans > 0).sum())
    share = count[count > 0] / count.sum()
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), letters / visible, digits / visible, upper / max(1.0, letters),
        marks / visible, odd / visible, high / visible, len(often) / n, float(often.max()) / n,
        1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0, 1 - len(np.unique(fives)) / len(fives) if len(fives) else 0.0,
        float(np.diff(changes).max()) / n, math.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        float(((_OF[firsts] & _UPPER) > 0).mean()), float(((_OF[lasts] & _MARK) > 0).mean()), 1 - min(1.0, lettered / n),
        float((lengths == 1).mean()), raw.count(b".") / n, float(-(share * np.log2(share)).sum()),
        len(squeeze.compress(raw)) / len(raw),
    ]


def table_of(raws) -> np.ndarray:
    """Statistics of several texts as rows."""
    hashes, squeeze = WordHashes(), zstandard.ZstdCompressor(level=1)
    return np.array([statistics(raw, hashes, squeeze) for raw in raws], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """All trees as arrays: ``feature`` and ``cut`` by tree and inner node, ``value`` by tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(self.feature)), np.int64)
            inner = self.feature.shape[1]
            while at.size and at[0, 0] < inner:  # all rows are on the same level
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
            total += self.value[trees, at - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Fit trees to 0/1 labels by the logistic loss."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(share / (1 - share))
    inner, none = 2**depth - 1, np.empty((0, 2**depth - 1))
    if len(np.unique(y)) < 2:
        return Trees(base, none.astype(np.int64), none, np.empty((0, 2**depth)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], 1)
    features = x.shape[1]
    cells = binned + np.arange(features) * bins
    total = np.full(len(y), base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            key = (cells + (node[:, None] * features * bins)).ravel()
            size = nodes * features * bins
            sums = [np.bincount(key, np.repeat(v, features), size).reshape(nodes, features, bins).cumsum(2)
                    for v in (gradient, weight, np.ones(len(y)))]
            (g, h, c), (g_all, h_all, c_all) = sums, [s[:, :, -1:] for s in sums]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(c < LEAST_ROWS) | (c_all - c < LEAST_ROWS)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for i, at in enumerate(best):
                f, b = divmod(int(at), bins)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + i], cut[first + i] = f, edges[f][b]
            f, t = feature[first + node], cut[first + node]
            node = 2 * node + (x[np.arange(len(y)), f] > t)
        value = rate * np.bincount(node, gradient, 2**depth) / (np.bincount(node, weight, 2**depth) + RIDGE)
        total = total + value[node]
        out.append((feature, cut, value))
    return Trees(base, *(np.stack(part) for part in zip(*out)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = ROWS) -> Trees:
    """Trees for at most ``rows`` labelled documents, those with the least hash of their number.

    The sample's keys are broadcast (``rows`` at most); the driver gets one row of statistics per sampled document.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    schema = ", ".join(f"f{i} double" for i in range(len(FEATURES))) + ", label int"

    def run(batches):
        for batch in batches:
            x = table_of(texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c) for c in x.T], batch.column("_label").cast(pa.int32())],
                names=[*[f"f{i}" for i in range(len(FEATURES))], "label"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "_label").mapInArrow(run, schema).toPandas()
    found = found.sort_values(list(found.columns)).to_numpy()  # sums in a fixed order, so reruns agree
    return boosted(found[:, :-1], found[:, -1])


def scored(text: Column, trees: Trees) -> Column:
    """The score of a text, from 0 to 1."""

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(trees.score(table_of((t or "").encode("utf-8", "replace") for t in batch)))

    return score(text)


def quality(docs: DataFrame, trees: Trees, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All rows and columns, with ``score`` (double) and ``predicted`` (int); columns of those names are replaced."""
    return docs.withColumn("score", scored(F.col(text), trees)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
