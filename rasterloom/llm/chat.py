"""Chat formatting at token level.

Role and text of every turn are encoded apart, as ordinary text, and the reserved ids of the template are spliced in
between: ``<start> role \\n text <end> \\n``. Since marks are ids, no text can imitate them; besides, control
strings inside texts are escaped, so that the written form can be parsed too. A turn's tokens are the segments
one after the other; their offsets, and the loss mask over assistant texts, are prefix sums of segment lengths.
Offsets within a conversation are running sums over its turns in order.

Escaping adds a backslash to every ``<\\...\\|`` (any number of backslashes), which undoes itself exactly.

Turns are rows. Null text or role is empty; a null turn comes first; rows that repeat a turn follow each other by
role, then ids. Rows without a conversation number are one conversation of their own. Texts of any length are
encoded whole; past ``SLICE`` characters they are cut where the pattern cuts anyway, which changes no id. A conversation may hold any number of turns:
encoding is spread over all tasks, and a conversation is only streamed in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import group_starts, lists, shuffle_partitions

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
SLICE = 20_000
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = "conv_id long, turn long, role string, ids array<int>, mask array<tinyint>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def one_line(role: str) -> str:
    """A role without line breaks, since a break ends the role; reversible."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def as_given(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def slices(text: str, size: int | None = None) -> Iterator[str]:
    """A long text in parts, cut only where the split pattern ends a piece: before a blank that a letter follows."""
    at, size = 0, size or SLICE
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while 0 <= end and not text[end + 1 : end + 2].isalpha():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Template:
    """Tokenizer and reserved ids; the ids follow those of the vocabulary."""

    def __init__(self, ranks: str = RANKS):
        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.start, self.end = max(table.values()) + 1, max(table.values()) + 2
        self.coder = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.newline = self.coder.encode_ordinary("\n")

    def segment(self, text: str) -> list[int]:
        """Ids of a text without marks, the same as of the text encoded at once."""
        return [i for part in slices(text) for i in self.coder.encode_ordinary(part)]

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn."""
        segments = [[self.start], self.segment(escape(one_line(role))), self.newline, self.segment(escape(text)), [self.end], self.newline]
        lengths = np.array([len(s) for s in segments])
        ends = np.cumsum(lengths)
        step = np.zeros(ends[-1] + 1, np.int8)
        if role == "assistant":
            # The mask rises at the start of the text and falls at its end.
            step[ends[2]] += 1
            step[ends[3]] -= 1
        return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(step[:-1]).astype(np.int8)

    def written(self, ids: np.ndarray) -> str:
        """The text form of ids."""
        out, at = [], 0
        for mark in np.flatnonzero(ids >= self.start):
            out += [self.plain(ids[at:mark]), START if ids[mark] == self.start else END]
            at = mark + 1
        return "".join([*out, self.plain(ids[at:])])

    def plain(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """Roles and texts, read back from ids."""
        starts, ends = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        turns = []
        for a, b in zip(starts, ends):
            role, _, text = self.plain(ids[a + 1 : b]).partition("\n")
            turns.append((as_given(unescape(role)), unescape(text)))
        return turns


def format_turns(conversations: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(conv_id, turn, role, ids, mask) per row; narrow. Line breaks in a role are written as ``\\n``, its backslashes twice."""

    def run(batches):
        template = Template(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                roles = [r or "" for r in part.column("role").to_pylist()]
                turns = [template.turn(r, t or "") for r, t in zip(roles, part.column("text").to_pylist())]
                lengths = [len(ids) for ids, _ in turns]
                yield pa.RecordBatch.from_pydict({
                    "conv_id": part.column("conv_id"), "turn": part.column("turn"), "role": pa.array(roles, pa.string()),
                    "ids": lists(np.concatenate([t[0] for t in turns]), lengths, pa.int32()),
                    "mask": lists(np.concatenate([t[1] for t in turns]), lengths, pa.int8())})

    long = lambda c: F.col(c).cast("long").alias(c)
    return conversations.select(long("conv_id"), long("turn"), "role", "text").mapInArrow(run, TURNS)


def in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation one after the other in one partition, in order; only ever streamed."""
    return turns.repartition(shuffle_partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")


def assemble(turns: DataFrame) -> DataFrame:
    """Adds ``offset``, the tokens before a turn in its conversation, and ``loss_offset``, those of them under the mask."""

    def run(batches):
        conversation, offset, loss = (), 0, 0
        for batch in batches:
            starts = {int(x) for x in group_starts(batch, "conv_id")}
            lengths = batch.column("ids").value_lengths().to_numpy()
            masked = [int(m.values.to_numpy().sum()) for m in batch.column("mask")]
            ids, offsets, losses = batch.column("conv_id").to_pylist(), [], []
            for i, (length, under) in enumerate(zip(lengths, masked)):
                if i in starts and (ids[i],) != conversation:
                    conversation, offset, loss = (ids[i],), 0, 0
                offsets.append(offset)
                losses.append(loss)
                offset, loss = offset + int(length), loss + under
            yield batch.append_column("offset", pa.array(offsets, pa.int64())).append_column("loss_offset", pa.array(losses, pa.int64()))

    return in_order(turns).mapInArrow(run, TURNS + ", offset long, loss_offset long")


def read_back(assembled: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Digests per conversation, from the ids and masks alone; the rows of a conversation are streamed in order.

    Digests are updated turn by turn, so any number of turns takes the same memory.
    """

    def run(batches):
        template = Template(ranks)
        now: list | None = None

        def done(c):
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([c[0]], pa.int64()), "n_turns": pa.array([c[1]], pa.int64()),
                "turns_sha256": pa.array([c[2].hexdigest()]), "loss_chars": pa.array([c[3]], pa.int64()),
                "loss_sha256": pa.array([c[4].hexdigest()]), "formatted_chars": pa.array([c[5]], pa.int64()),
                "n_tokens": pa.array([c[6]], pa.int64())})

        for batch in batches:
            out = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                for role, text in template.read(ids):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                under = unescape(template.plain(ids[mask == 1]))
                now[3] += len(under)
                now[4].update(under.encode())
                now[5] += len(template.written(ids))
                now[6] += len(ids)
            yield from out
        if now is not None:
            yield done(now)

    return assembled.select("conv_id", "ids", "mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_tokens long")


