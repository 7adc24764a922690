"""Batches of files through a tool that may fail on any of them.

A *file kernel* is made by a loader (once per Python worker and run) and turns one file, given as a dict of the
columns it reads, into a dict of output columns. What it raises is caught with the file: the run goes on, and the
row keeps its place in the list with ``ok`` and ``message``. Kernels are pure (one row in, one row out, nothing else
touched), so a task that is run again, or twice at once, gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructType

from rasterloom.functions.scale import stored
from rasterloom.functions.ship import ship_package

# What a worker has loaded, by run; the oldest goes first.
_LOADED: dict[str, object] = {}
KEPT_LOADED = 4


class ToolError(Exception):
    """A failure with a message for the reader."""


def loaded(token: str, loader: Callable):
    """The loader's result, made once per Python worker and ``token``."""
    if token not in _LOADED:
        while len(_LOADED) >= KEPT_LOADED:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[token] = loader()
    return _LOADED[token]


def _attempt(kernel: Callable[[dict], dict], file: dict, fallback: str) -> tuple[dict, str | None]:
    try:
        return kernel(file), None
    except ToolError as error:
        return {}, str(error) or fallback
    except Exception:  # noqa: BLE001 - whatever one file does must not end the batch
        return {}, fallback


def attempt(
    files: DataFrame, loader: Callable[[], Callable[[dict], dict]], output: str, fallback: str,
    reads: list[str], drops: tuple[str, ...] = (), refused: str | None = None,
) -> DataFrame:
    """``files`` with the columns of ``output``, ``ok`` and ``message``; one row for each, whatever happens.

    The kernel sees the columns ``reads`` only. Columns in ``drops`` (file contents, say) go in but not out. A row
    whose column ``refused`` is not null is not attempted: that text is its message, and its contents don't travel to Python.
    A failed row has null outputs.
    """
    ship_package(files.sparkSession)
    if refused is not None:
        open_ = F.col(refused).isNull()
        files = files.withColumns({c: F.when(open_, F.col(c)).alias(c) for c in drops})
    kept = [f for f in files.schema.fields if f.name not in drops]
    made = StructType.fromDDL(output)
    clash = {f.name for f in kept} & {*made.names, "ok", "message"}
    if clash:
        raise ValueError(f"the output would replace columns of the files: {sorted(clash)}")
    schema = StructType([*kept, *made.fields]).add("ok", BooleanType(), False).add("message", StringType())
    types, token = to_arrow_schema(made), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = loaded(token, loader)
        for batch in batches:
            said = batch.column(refused).to_pylist() if refused is not None else [None] * batch.num_rows
            columns = [batch.column(c) for c in reads]
            results, messages = [], []
            for row, no in enumerate(said):
                out, message = ({}, no) if no is not None else _attempt(kernel, {c: v[row].as_py() for c, v in zip(reads, columns)}, fallback)
                results.append(out)
                messages.append(message)
            arrays = {f.name: batch.column(f.name) for f in kept}
            arrays |= {f.name: pa.array([r.get(f.name) for r in results], f.type) for f in types}
            arrays["ok"] = pa.array([m is None for m in messages], pa.bool_())
            arrays["message"] = pa.array(messages, pa.string())
            yield pa.RecordBatch.from_pydict(arrays)

    return files.mapInArrow(run, schema)


def settle(run: DataFrame, outputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """The run written once, then (renditions, failures): what was made, and what failed and why."""
    done = stored(run, "batch")
    return done.filter("ok").drop("ok", "message"), done.filter("not ok").drop("ok", *outputs)


def in_byte_shares(files: DataFrame, size: Column, share: int = 64 << 20) -> DataFrame:
    """Files spread so that a task holds about ``share`` bytes; a few huge files don't meet in one task."""
    total = files.agg(F.sum(size)).first()[0] or 0
    return files.repartition(max(1, -(-int(total) // share), files.sparkSession.sparkContext.defaultParallelism))
