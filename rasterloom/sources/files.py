"""A sink for one file per row: a Python data source whose writers put documents straight to their places.

``df.write.format("rasterfiles").option("path", uri).mode("append").save()`` takes rows (folder, name, content) and
writes ``uri/folder/name``. A file is written beside its place under a name of its own and then moved there, so a reader
sees whole files only, and a task that is run again, or twice at once, leaves the same files. A failed task takes back what
it had not moved yet. The job's commit writes ``_SUCCESS`` with the number of files and bytes; an aborted job has none.
Files of earlier runs stay unless a row replaces them.

Folder and name are percent-encoded, apart from plain characters. A null content is an empty file. Rows that share a place
are one file, of either of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rasterloom.functions.ship import ship_package

FORMAT, COLUMNS = "rasterfiles", ("folder", "name", "content")
# Bytes of one writing task.
SHARE = 64 << 20
# Names in a batch of a listing.
LISTED = 10_000
TEXTS = pa.schema([("folder", pa.string()), ("name", pa.string()), ("text", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def place(part: str | None) -> str:
    """A folder or file name that is one path segment, and none that listings skip."""
    text = quote(part or "", safe=" =,()@") or "%00"
    return f"%{ord(text[0]):02X}{text[1:]}" if text[0] in "._" else text


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = self._store()
        files, size, made, waiting = 0, 0, set(), None
        try:
            for batch in iterator:
                for folder, name, content in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                    at = f"{base.rstrip('/')}/{place(folder)}"
                    if at not in made:
                        store.create_dir(at, recursive=True)
                        made.add(at)
                    waiting = f"{at}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(waiting) as out:
                        out.write(content or b"")
                    store.move(waiting, f"{at}/{place(name)}")
                    waiting = None
                    files, size = files + 1, size + len(content or b"")
        except BaseException:
            if waiting is not None:
                store.delete_file(waiting)
            raise
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        store, base = self._store()
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base.rstrip('/')}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are in place stay: they are whole, and a rerun replaces them. The mark of an earlier run goes."""
        store, base = self._store()
        mark = f"{base.rstrip('/')}/_SUCCESS"
        if store.get_file_info(mark).is_file:
            store.delete_file(mark)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if set(schema.names) != set(COLUMNS):
            raise ValueError(f"expected the columns {COLUMNS}, got {schema.names}")
        return FilesWriter(self.options["path"])


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority of the file system that Spark would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString()


def write_files(files: DataFrame, path: str, folder: Column, name: Column, content: Column, share: int = SHARE) -> None:
    """Writes ``content`` to ``path/folder/name``; tasks get about ``share`` bytes each, so no folder is one task.

    Rows that lie in parts of that size already are written from where they are, others are dealt out.
    """
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(FilesSource)
    rows = files.select(folder.alias("folder"), name.alias("name"), content.cast("binary").alias("content"))
    parts = [n or 0 for _, n in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("content"))).collect()]
    cores, size = spark.sparkContext.defaultParallelism, sum(parts)
    tasks = max(cores, -(-size // share))
    # Apart from their number, the largest part says how even they are.
    if len(parts) < cores or max(parts) > max(share, 2 * size // tasks):
        rows = rows.repartition(int(tasks), "folder", "name")
    rows.write.format(FORMAT).option("path", qualified(spark, path)).mode("append").save()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, text) of the files in the folders below ``path``, names decoded, empty files included.

    Spark's own file sources pass over empty files and plan each small file as a split. Here tasks list the folders, and the
    names are dealt out to tasks that read them, in batches of ``SHARE`` bytes at most (or one file).
    """
    from pyarrow import fs

    ship_package(spark)
    uri = qualified(spark, path)
    seen = lambda info: not info.base_name.startswith((".", "_"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                names = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}")) if i.is_file and seen(i)]
                for at in range(0, len(names), LISTED):
                    part = names[at : at + LISTED]
                    yield pa.RecordBatch.from_pydict({"folder": [folder] * len(part), "name": part})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows, size = [], 0
            for folder, name in zip(*(batch.column(c).to_pylist() for c in ("folder", "name"))):
                with store.open_input_stream(f"{base.rstrip('/')}/{folder}/{name}") as file:
                    text = file.read().decode()
                rows.append({"folder": unquote(folder), "name": unquote(name), "text": text})
                size += len(text)
                if size >= SHARE:
                    yield pa.RecordBatch.from_pylist(rows, TEXTS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, TEXTS)

    store, base = fs.FileSystem.from_uri(uri)
    folders = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(base)) if not i.is_file and seen(i)]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = spark.createDataFrame(folders, "folder string").mapInArrow(listed, "folder string, name string")
    return names.repartition(tasks, "folder", "name").mapInArrow(opened, "folder string, name string, text string")
