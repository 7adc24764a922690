"""The tool dimension (fixed, twelve rows) and the plug-in registry.

A plug-in has one of three forms: a transformation ``DataFrame -> DataFrame``; an iterator kernel that works on Arrow
batches with state loaded once per worker; a table function (``@udtf``) with a table argument, whose ``analyze``
derives the output's columns from the input's. Chains mix them freely.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.functions.ship import ship_package
from rasterloom.operators.runner import loaded

# Id, title, most files (None = no cap), batch, name suffix, forced extension.
TOOLS = [
    ("resize", "Resize & transform", 1, False, "edited", None),
    ("scale", "Batch scale", None, True, "scaled", None),
    ("convert", "Convert format", None, True, "converted", None),
    ("convert-svg", "Convert to SVG", None, True, "vector", "svg"),
    ("compress", "Compress images", None, True, "compressed", None),
    ("strip-metadata", "Strip metadata", None, True, "clean", None),
    ("remove-background", "Remove background", None, True, "transparent", "png"),
    ("adjust", "Adjust & filters", None, True, "adjusted", None),
    ("margin", "Add margin", None, True, "margin", None),
    ("merge", "Merge images", None, True, "merged", "png"),
    ("upscale", "Upscale image", None, True, "upscaled", "png"),
    ("ocr", "Extract text (OCR)", None, True, "", "txt"),
]
ACCEPTED_TYPES = ["image/jpeg", "image/png", "image/webp"]

Transform = Callable[..., DataFrame]


@dataclass(frozen=True)
class Kernel:
    """``loader(**params)`` gives a function from a batch to the arrays of ``output``, which join or replace its columns."""

    loader: Callable[..., Callable[[pa.RecordBatch], dict[str, pa.Array]]]
    output: str

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        ship_package(df.sparkSession)
        made = StructType.fromDDL(self.output)
        schema = StructType([made[f.name] if f.name in made.names else f for f in df.schema.fields])
        schema = StructType([*schema.fields, *[f for f in made.fields if f.name not in schema.names]])
        loader, names, token = self.loader, schema.names, uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel = loaded(token, lambda: loader(**params))
            for batch in batches:
                arrays = dict(zip(batch.schema.names, batch.columns)) | kernel(batch)
                yield pa.RecordBatch.from_pydict({n: arrays[n] for n in names})

        return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class TableFunction:
    """A ``udtf`` that takes the table first and its parameters by name; ``keys`` brings rows of a key to one call."""

    function: Callable
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        ship_package(df.sparkSession)
        table = df.asTable()
        if self.keys:
            table = table.partitionBy(*self.keys)
            table = table.orderBy(*self.order) if self.order else table
        return self.function(table, **{k: F.lit(v) for k, v in params.items()})


_PLUGINS: dict[str, Transform | Kernel | TableFunction] = {}


def tools(spark: SparkSession) -> DataFrame:
    """Twelve fixed rows, safe to broadcast."""
    rows = [(*t[:2], ACCEPTED_TYPES, *t[2:]) for t in TOOLS]
    return spark.createDataFrame(
        rows,
        "tool_id string, title string, accepted_types array<string>, max_files int, batch boolean, "
        "suffix string, out_ext string",
    )


def accepts(spark: SparkSession) -> DataFrame:
    """(tool_id, mime): one row per type a tool accepts."""
    return tools(spark).select("tool_id", "batch", F.explode("accepted_types").alias("mime"))


def _register(name: str, plugin) -> None:
    if name in _PLUGINS:
        raise ValueError(f"tool {name!r} is already registered")
    _PLUGINS[name] = plugin


def register_tool(name: str, transform: Transform) -> None:
    """Add a ``DataFrame -> DataFrame`` tool under ``name``."""
    _register(name, transform)


def register_kernel(name: str, loader: Callable, output: str) -> None:
    """Add an iterator kernel (see :class:`Kernel`)."""
    _register(name, Kernel(loader, output))


def register_table_function(name: str, function: Callable, keys: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """Add a table function (see :class:`TableFunction`)."""
    _register(name, TableFunction(function, keys, order))


def registered() -> list[str]:
    return sorted(_PLUGINS)


def apply_tool(df: DataFrame, name: str, **params) -> DataFrame:
    return df.transform(_PLUGINS[name], **params)


def chain_tools(df: DataFrame, *steps: tuple[str, dict]) -> DataFrame:
    """Feed the output of each registered tool into the next one."""
    for name, params in steps:
        df = apply_tool(df, name, **params)
    return df
