"""Toxicity: a weighted lexicon found by an Aho-Corasick automaton in folded text.

Every word is folded first (compatibility forms, look-alike letters, digits and signs used as
letters, stretched letters, dots inside), so that a disguised word meets the same entry. The
lexicon is learned from labelled rows: word beginnings that are much more frequent in toxic
documents. Phrases of clean documents that contain an entry become exceptions and hide it.
The weights found, alone and by length of text, give the score through a logistic curve.

Null and empty texts hold no entry: they get the score of a text without any. Rows are
handled one by one, so repeated rows and ties get equal scores; all other columns are kept.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import stored
from rasterloom.llm.common import texts

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_LETTERS = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(SUBSTITUTES)
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
_ENDS = re.compile(r"^[^\w@$]+|\W+$")
_INNER = re.compile(r"[\W_]+")
_STRETCH = re.compile(r"(\D)\1{2,}")
CACHE = 1 << 17
# Least and most letters of an entry.
LETTERS = (1, 32)


def fold_word(word: bytes) -> str:
    """The folded form of a word; empty where it holds no letter."""
    text = word.decode("utf-8", "replace").lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).translate(_LETTERS)
    if not text.isalpha():
        text = _ENDS.sub("", text)
        if any(map(str.isalpha, text)):
            text = _INNER.sub("", text.translate(_SIGNS))
        else:
            return ""
    return _STRETCH.sub(r"\1", text)


class Folded(dict):
    """Folded words, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = fold_word(word)
        return value

    def text(self, raw: bytes) -> tuple[str, int]:
        """All folded words between single blanks, and their number."""
        words = raw.split()
        return f" {' '.join([w for w in map(self.__getitem__, words) if w])} ", len(words)


@dataclass
class Model:
    """``lexicon``: beginning -> (weight, letters that may follow at most); ``exceptions``: phrases that hide entries."""

    lexicon: dict[str, tuple[float, int]]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (0.0, -1, len(phrase)))
        for start, (weight, rest) in self.lexicon.items():
            found.add_word(f" {start}", (weight, rest, len(start)))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(first, last, weight) of the entries in a folded text that no exception covers."""
    if not len(automaton):
        return []
    found, hidden = [], []
    for end, (weight, rest, length) in automaton.iter(text):
        if rest < 0:
            hidden.append((end - length, end - 1))
        elif text.find(" ", end + 1, end + rest + 2) >= 0:
            found.append((end - length + 1, end, weight))
    if not hidden:
        return found
    # Of the exceptions that begin at or before an entry, the one that reaches furthest decides.
    hidden.sort()
    begins, reach = [a for a, _ in hidden], list(itertools.accumulate((b for _, b in hidden), max))
    return [f for f in found if not (k := bisect.bisect_right(begins, f[0])) or reach[k - 1] < f[1]]


def inputs(automaton: ahocorasick.Automaton, text: str, words: int) -> tuple[float, float]:
    """Total weight, and weight by length of text, both on a log scale."""
    found = hits(automaton, text)
    best: dict[int, float] = {}
    for first, _, weight in found:
        best[first] = max(best.get(first, 0.0), weight)
    total = sum(best.values())
    return math.log1p(total), math.log1p(1000 * total / (words + 50))


def scored(text: Column, model: Model) -> Column:
    """The score of a text, from 0 to 1."""
    state: list = []

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        if not state:
            state.extend((model.automaton(), Folded()))
        automaton, folded = state
        a, b, c = model.curve
        out = []
        for raw in batch:
            x, y = inputs(automaton, *folded.text((raw or "").encode("utf-8", "replace")))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))))
        return pd.Series(out, dtype="float64")

    return score(text)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """All rows and columns, with ``score`` (double) and ``predicted`` (int).

    Columns of those two names are replaced. Narrow: nothing is shuffled.
    """
    return docs.withColumn("score", scored(F.col(text), model)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def labelled_sample(labels: DataFrame, usable: Column, label: str, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled keys of each class, those with the least hash; ``usable`` picks the rows to learn from."""
    labels = labels.filter(F.col(key).isNotNull() & usable)
    parts = [
        labels.filter(F.col(label) == value).groupBy(key).agg(F.min(label).alias("_label"))
        .orderBy(F.xxhash64(key), key).limit(rows)
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1]).groupBy(key).agg(F.max("_label").cast("int").alias("_label"))


def sampled_texts(docs: DataFrame, labels: DataFrame, usable: Column, label: str, rows: int) -> DataFrame:
    """Texts of the sample with their ``_label``. The sample has at most 2 x ``rows`` keys, so it is broadcast."""
    sample = labelled_sample(labels, usable, label, rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "_label")


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = 6_000,
    entries: int = 5_000, ratio: float = 6.0, evidence: float = 20.0, exceptions: tuple[str, ...] = (), letters: tuple[int, int] = LETTERS,
) -> Model:
    """Learn lexicon, exceptions and curve from at most ``rows`` labelled rows of each class.

    An entry must be ``ratio`` times as frequent in toxic as in clean text, with a log-likelihood
    ratio of ``evidence`` at least; ``entries`` bounds the lexicon, those with the least gain fall off. An entry is a word or the beginning
    of words, of ``letters`` (least, most) letters; a longer word is known by its first ones. A word counts once for each
    word it follows, so that copies of one document count as one. Counting runs on Spark; the
    driver gets candidates (at most ten times ``entries``), exceptions and two numbers per sampled
    row. Without toxic rows nothing is ever found.
    """
    sample = sampled_texts(docs, labels, usable, label, rows)
    pairs = sample.mapInArrow(_pairs, "word string, before int, _label int").distinct()
    counted = pairs.select("word", "_label").mapInArrow(
        _beginnings(letters), "start string, whole long, toxic long, clean long"
    ).groupBy("start").agg(*[F.sum(c).alias(c) for c in ("whole", "toxic", "clean")])
    counted = stored(counted, "toxicity")
    totals = counted.filter("start = ''").first()
    lexicon: dict[str, tuple[float, int]] = {}
    if totals and totals["toxic"] and totals["clean"]:
        expected = (F.col("clean") + 1) * (totals["toxic"] / totals["clean"])
        weight = F.log(F.col("toxic") / expected)
        gain = F.col("toxic") * weight - F.col("toxic") + expected
        found = (
            counted.filter("start <> '' and toxic > 0").withColumn("weight", weight).withColumn("gain", gain)
            .filter((F.col("weight") >= math.log(ratio)) & (F.col("gain") >= evidence))
            .orderBy(F.desc("gain"), F.desc(F.length("start")), "start").limit(10 * entries).collect()
        )
        lexicon = _chosen(found, entries)
    model = Model(lexicon, list(exceptions))
    if lexicon:
        sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
        toxic, clean = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
        phrases = (
            sample.mapInArrow(_phrases(model), "phrase string, toxic long, clean long").groupBy("phrase")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter((F.col("clean") >= 5) & (F.col("clean") / clean >= 10 * F.col("toxic") / toxic))
            .orderBy(F.desc("clean"), "phrase").limit(entries).collect()
        )
        model.exceptions += [r["phrase"] for r in phrases]
    points = sample.mapInArrow(_points(model), "x double, y double, label int").toPandas()
    model.curve = _logistic(points[["x", "y"]].to_numpy(), points["label"].to_numpy())
    return model


def _pairs(batches):
    """Every word with the hash of the word before it, once per document."""
    folded = Folded()
    for batch in batches:
        words, before, labels = [], [], []
        for raw, label in zip(texts(batch, "text"), batch.column("_label").to_pylist()):
            line = folded.text(raw)[0].split()
            seen = {(w, zlib.crc32(b.encode()) >> 1) for b, w in zip(["", *line], line)}
            words += [w for w, _ in seen]
            before += [b for _, b in seen]
            labels += [label] * len(seen)
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(words, pa.string()), "before": pa.array(before, pa.int32()), "_label": pa.array(labels, pa.int32())})


def _beginnings(letters: tuple[int, int]):
    """Partly counted word beginnings, all words under the empty one; ``whole``: it is a word of its own."""

    def run(batches):
        for batch in batches:
            words = Counter(zip(batch.column("word").to_pylist(), batch.column("_label").to_pylist()))
            counts: dict[str, list[int]] = {}
            for (word, label), n in words.items():
                for length in (0, *range(letters[0], min(len(word), letters[1]) + 1)):
                    of = counts.setdefault(word[:length], [0, 0, 0])
                    of[2 - label] += n
                    of[0] += n * (length == len(word))
            columns = list(zip(*counts.values())) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({
                "start": pa.array(list(counts), pa.string()), "whole": pa.array(columns[0], pa.int64()),
                "toxic": pa.array(columns[1], pa.int64()), "clean": pa.array(columns[2], pa.int64())})

    return run


def _chosen(found: list, entries: int) -> dict[str, tuple[float, int]]:
    """Entries by falling gain; what begins like a chosen one, or is a beginning of it, goes."""
    kept: dict[str, tuple[float, int]] = {}
    beginnings: set[str] = set()
    for row in found:
        start = row["start"]
        if start in beginnings or any(start[:n] in kept for n in range(1, len(start))):
            continue
        beginnings.update(start[:n] for n in range(1, len(start) + 1))
        alone = row["whole"] >= 0.97 * (row["toxic"] + row["clean"])
        kept[start] = (row["weight"], 1 if alone else 64)
        if len(kept) == entries:
            break
    return kept


def _phrases(model: Model):
    """The words around each entry that was found: alone, with the word before and with the word after."""

    def run(batches):
        automaton, folded = model.automaton(), Folded()
        for batch in batches:
            counts: Counter = Counter()
            for raw, label in zip(texts(batch, "text"), batch.column("_label").to_pylist()):
                text, _ = folded.text(raw)
                seen = set()
                for first, _, _ in hits(automaton, text):
                    end = text.index(" ", first)
                    before, after = text.rfind(" ", 0, max(0, first - 1)) + 1, text.find(" ", end + 1)
                    seen.add(text[first:end])
                    seen.add(text[before:end])
                    seen.add(text[first:after] if after > 0 else text[first:end])
                counts.update((s.strip(), int(label)) for s in seen)
            keys = list({k for k, _ in counts})
            yield pa.RecordBatch.from_pydict({
                "phrase": pa.array(keys, pa.string()), "toxic": pa.array([counts[(k, 1)] for k in keys], pa.int64()),
                "clean": pa.array([counts[(k, 0)] for k in keys], pa.int64())})

    return run


def _points(model: Model):
    def run(batches):
        automaton, folded = model.automaton(), Folded()
        for batch in batches:
            at = [inputs(automaton, *folded.text(raw)) for raw in texts(batch, "text")]
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([p[0] for p in at], pa.float64()), "y": pa.array([p[1] for p in at], pa.float64()),
                "label": batch.column("_label").cast(pa.int32())})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, ...]:
    """Intercept and non-negative slopes of a logistic curve, by Newton's method; both classes weigh the same."""
    if len(np.unique(y)) < 2:
        return (-3.0, 0.0, 0.0)
    weight = np.where(y == 1, 0.5 / np.mean(y == 1), 0.5 / np.mean(y == 0))
    use = [0, 1, 2]
    full = np.column_stack([np.ones(len(x)), x])
    while True:
        a, beta = full[:, use], np.zeros(len(use))
        ridge = penalty * np.eye(len(use))
        ridge[0, 0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            slope = a.T @ (weight * (y - p)) - ridge @ beta
            step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, slope)
            beta = beta + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        wrong = [i for i, b in zip(use, beta) if i and b < 0]
        if not wrong:
            break
        use = [i for i in use if i not in wrong[:1]]
    out = np.zeros(3)
    out[use] = beta
    return tuple(float(b) for b in out)
