"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for every vocabulary piece that matches, with the piece's score, and for
characters without a piece one edge of byte pieces that scores below all pieces. Forward Viterbi gives the best score
up to every position. It is the exact heuristic of an A* search from the end backwards, which
meets complete segmentations in order of their score, so the first N are the N best.

No piece holds a blank after another character, so every path passes each start of a blank run; there the
lattice falls into independent chunks. Forward scores are computed once per different chunk; a document's N
best segmentations differ from its best one in the chunks with the least losses only, and only those
are searched. Whole texts are segmented, whatever their length.

Results per row: ``ids`` (best segmentation), ``score``, and ``alternatives``, best first: its score and the
stretches of ``ids`` it replaces. Equal scores keep the order in which the search meets them. Null and empty texts
have no pieces, score 0 and no alternatives. Rows are handled one by one, also if they repeat.
Decoding gives back exactly the text that was encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from rasterloom.llm.common import lists, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
SEARCHED = 1 << 14
CACHE = 300_000
SWAPS = "array<struct<start int, length int, ids array<int>>>"
ALTERNATIVES = f"array<struct<score double, swaps {SWAPS}>>"
_ARROW = pa.list_(pa.struct([
    ("score", pa.float64()),
    ("swaps", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
LOWEST = float("-inf")


def _fixed(tree: dict) -> dict:
    return {c: (_fixed(children), score, piece) for c, (children, score, piece) in tree.items()}


class Pieces:
    """The vocabulary as a tree of characters, with blanks in plain form: character -> (children, score or None, id)."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_: dict[int, int] = {}
        self.spelled: dict[int, bytes] = {}
        tree: dict = {}
        lowest, split, self.longest = 0.0, True, 1
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = piece.replace("▁", " ")
                self.spelled[i] = plain.encode()
                split = split and " " not in plain.lstrip(" ")
                lowest = min(lowest, model.get_score(i)) if model.get_score(i) > -1e8 else lowest
                self.longest = max(self.longest, len(plain))
                children = tree
                for c in plain[:-1]:
                    children = children.setdefault(c, [{}, None, 0])[0]
                children.setdefault(plain[-1], [{}, None, 0])[1:] = [model.get_score(i), i]
        if len(self.bytes_) < 256:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        spelled = [self.spelled.get(i, b"") for i in range(model.get_piece_size())]
        self.lengths = np.array([len(x) for x in spelled])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.tree = _fixed(tree)
        self.other = lowest - 10.0
        self.chunks = re.compile(r" *[^ ]+| +" if split else r"(?s).+").findall

    def byte_ids(self, character: str) -> list[int]:
        return [self.bytes_[b] for b in character.encode()]

    def starting(self, text: str, i: int):
        """(end, score, id) of every piece that starts at ``i``."""
        children = self.tree
        for j in range(i, len(text)):
            found = children.get(text[j])
            if found is None:
                return
            children, score, piece = found
            if score is not None:
                yield j + 1, score, piece

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end position the edges (start, score, ids) that reach it."""
        into: list = [[] for _ in range(len(text) + 1)]
        for i in range(len(text)):
            found = list(self.starting(text, i))
            for j, score, piece in found:
                into[j].append((i, score, (piece,)))
            if not found or found[0][0] > i + 1:
                into[i + 1].append((i, self.other, tuple(self.byte_ids(text[i]))))
        return into

    def forward(self, text: str) -> tuple[bytes, float, float]:
        """Best segmentation as int32 ids, its score, and how much the second best loses (infinite if there is none)."""
        n = len(text)
        best, second = [LOWEST] * (n + 1), [LOWEST] * (n + 1)
        back, by = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        # The tree is walked in place, with its names at hand: this is the innermost loop of the operator.
        first, longest, strange = self.tree.get, self.longest, self.other
        for i, c in enumerate(text):
            here, there, j = best[i], second[i], i + 1
            found = first(c)
            if found is None or found[1] is None:
                total = here + strange
                old, piece = best[j], -1
                other = there + strange
            else:
                _, score, piece = found
                total = here + score
                old, other = best[j], there + score
            if total > old:
                second[j] = old if old > other else other
                best[j], back[j], by[j] = total, i, piece
            elif total > second[j]:
                second[j] = total
            if found is None:
                continue
            children = found[0]
            for c in text[j : i + longest]:
                found = children.get(c)
                if found is None:
                    break
                j += 1
                children, score, piece = found
                if score is None:
                    continue
                total, old = here + score, best[j]
                if total > old:
                    other = there + score
                    second[j] = old if old > other else other
                    best[j] = total
                    back[j] = i
                    by[j] = piece
                elif total > second[j]:
                    second[j] = total
        ids: list[int] = []
        while n:
            if by[n] >= 0:
                ids.append(by[n])
            else:
                ids.extend(reversed(self.byte_ids(text[back[n]])))
            n = back[n]
        ids.reverse()
        return array("i", ids).tobytes(), best[-1], best[-1] - second[-1]

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations with their scores: backward A* under the forward scores."""
        into = self.edges(text)
        ahead = [0.0] + [LOWEST] * len(text)
        for j in range(1, len(text) + 1):
            ahead[j] = max(ahead[i] + score for i, score, _ in into[j])
        out, met = [], 0
        agenda: list = [(-ahead[-1], 0, len(text), 0.0, None)]
        while agenda and len(out) < n:
            _, _, at, done, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for i, score, ids in into[at]:
                met += 1
                # Of equal scores the latest first: a tie is followed to its end, not widened.
                heapq.heappush(agenda, (-(ahead[i] + score + done), -met, i, done + score, (ids, path)))
        return out

    def decode(self, ids) -> bytes:
        """The text of a segmentation, without the blank that encoding puts in front."""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        # Every byte comes from its piece's start plus its place in the piece.
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.letters[at].tobytes()[1:]


class Chunks(dict):
    """Forward results per chunk, for a bounded number of chunks; those of the generation before are still known."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.before = pieces, {}
        self.searched: dict[tuple[str, int], list] = {}

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """N-best results, which the cheapest chunks of many texts share; a bounded number is remembered."""
        found = self.searched.get((chunk, n))
        if found is None:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            found = self.pieces.nbest(chunk, n)
            if len(chunk) < 64:
                self.searched[(chunk, n)] = found
        return found

    def __missing__(self, chunk: str):
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        value = self.before.get(chunk) or self.pieces.forward(chunk)
        if len(chunk) < 64:
            self[chunk] = value
        return value


def nearest(losses: np.ndarray, n: int) -> list[int]:
    """Positions of the ``n`` least finite losses, the first ones among equals, in order of position."""
    if len(losses) > n:
        limit = np.partition(losses, n - 1)[n - 1] if n else LOWEST
        at = np.concatenate([np.flatnonzero(losses < limit), np.flatnonzero(losses == limit)])[:n]
    else:
        at = np.arange(len(losses))
    return sorted(at[losses[at] < float("inf")].tolist())


def segment(text: str, chunks: Chunks, n: int) -> tuple[np.ndarray, float, list[dict]]:
    """Best ids, their score and the alternatives of a text."""
    if not text:
        return np.empty(0, np.int32), 0.0, []
    parts = chunks.pieces.chunks(" " + text)
    found = [chunks[c] for c in parts]
    ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
    total = sum([f[1] for f in found])
    # One swap in each of the n - 1 cheapest chunks gives n - 1 alternatives already; others lose more.
    ways: list[tuple[float, tuple]] = [(0.0, ())]
    for i in nearest(np.array([f[2] for f in found]), n - 1):
        own, best = tuple(np.frombuffer(found[i][0], np.int32).tolist()), found[i][1]
        # Among equal scores the forward pass and the search may differ; the forward one stays first.
        options = [(best, own), *[o for o in chunks.nbest(parts[i], n) if o[1] != own][: n - 1]]
        ways = sorted(
            ((loss + best - score, swaps if k == 0 else (*swaps, (i, way))) for loss, swaps in ways
             for k, (score, way) in enumerate(options)), key=lambda w: w[0])[:n]
    if len(ways) > 1:
        starts = np.concatenate([[0], np.cumsum([len(f[0]) // 4 for f in found])])
    alternatives = [
        {"score": total - loss, "swaps": [
            {"start": int(starts[i]), "length": int(starts[i + 1] - starts[i]), "ids": list(way)} for i, way in swaps]}
        for loss, swaps in ways[1:]
    ]
    return ids, total, alternatives


def swapped(ids, swaps) -> list[int]:
    """The ids of an alternative."""
    ids = list(ids)
    for s in sorted(swaps, key=lambda s: -s["start"]):
        ids[s["start"] : s["start"] + s["length"]] = s["ids"]
    return ids


def encode(docs: DataFrame, model: str = MODEL, n: int = BEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, score, alternatives) per row. ``model`` is a file that every executor can read at this path."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        chunks = Chunks(Pieces(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # ids take more room than text
                part = batch.slice(at, 512)
                done = [segment(raw.decode("utf-8", "replace"), chunks, n) for raw in texts(part, text)]
                yield pa.RecordBatch.from_pydict({
                    key: part.column(key), "ids": lists(np.concatenate([d[0] for d in done]), [len(d[0]) for d in done], pa.int32()),
                    "score": pa.array([d[1] for d in done], pa.float64()),
                    "alternatives": pa.array([d[2] for d in done], _ARROW)})

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, score double, alternatives {ALTERNATIVES}")


def decode(encoded: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """(key, text) of segmentations in ``ids``; null or empty ids are an empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        pieces = Pieces(model)
        for batch in batches:
            out = [pieces.decode(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "text": pa.array(out, pa.string())})

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def report(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Digests of an encoding: number and SHA-256 of the ids (int32, little-endian), scores, and the decoded text's SHA-256.

    ``n_alternatives`` counts the alternatives, ``alternatives_decode`` tells whether each decodes to the same text.
    """

    def run(batches):
        pieces = Pieces(model)
        for batch in batches:
            rows = []
            for ids, score, others in zip(batch.column("ids"), batch.column("score").to_pylist(), batch.column("alternatives").to_pylist()):
                ids = ids.values.to_numpy()
                text = pieces.decode(ids)
                same = all(
                    b"".join(map(pieces.spelled.__getitem__, s["ids"]))
                    == b"".join(map(pieces.spelled.__getitem__, ids[s["start"] : s["start"] + s["length"]]))
                    for o in others for s in o["swaps"])
                rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), score,
                             [o["score"] for o in others], same, hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_ids": pa.array(columns[0], pa.int64()),
                "ids_sha256": pa.array(columns[1], pa.string()), "score": pa.array(columns[2], pa.float64()),
                "other_scores": pa.array(columns[3], pa.list_(pa.float64())),
                "alternatives_decode": pa.array(columns[4], pa.bool_()), "decoded_sha256": pa.array(columns[5], pa.string())})

    return encoded.mapInArrow(
        run, "doc_id long, n_ids long, ids_sha256 string, score double, other_scores array<double>, "
        "alternatives_decode boolean, decoded_sha256 string")
