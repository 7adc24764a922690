"""Image files, metadata, stream and sinks."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.operators import exif as E
from rasterloom.operators import tools as T
from rasterloom.sources import exif as reader
from rasterloom.sources import files
from rasterloom.sources import fixtures as X
from rasterloom.sources import images as S
from rasterloom.sources import png, sinks
from rasterloom.streaming import intake as stream
from conftest import SF


def test_scan_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    rgba = rng.integers(0, 256, (3, 5, 4)).astype("uint8")
    (tmp_path / "a.png").write_bytes(png.encode(5, 3, rgba.tobytes()))
    (tmp_path / "bad.png").write_bytes(b"no image")
    scanned = S.scan_images(spark, str(tmp_path))
    assert [r.origin.split("/")[-1] for r in S.rejects(scanned).collect()] == ["bad.png"]
    head = S.headers(scanned).collect()
    assert [(r.width, r.height, r.has_alpha) for r in head] == [(5, 3, True)]
    rows = S.pixels(scanned).collect()
    assert len(rows) == 15
    for r in rows:
        assert (r.r, r.g, r.b, r.a) == tuple(int(v) for v in rgba[r.y, r.x])
    listed = {(r.path.rsplit("/", 1)[1], r.reason, r.content is None) for r in S.scan_files(spark, str(tmp_path), 8).collect()}
    assert ("bad.png", None, False) in listed and {x[1:] for x in listed - {("bad.png", None, False)}} == {("too_large", True)}


def tiff(order, entries, extra=b""):
    e = "<" if order == b"II" else ">"
    body = struct.pack(e + "H", len(entries)) + b"".join(struct.pack(e + "HHI", *x[:3]) + x[3] for x in entries)
    data = order + struct.pack(e + "HI", 42, 8) + body + extra
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xd9"


def test_tag_reader():
    motorola = tiff(b"MM", [(0x0110, 2, 4, b"X1\0\0"), (0x0112, 3, 1, b"\0\x06\0\0"), (0x8827, 5, 1, b"\0\0\0\0")])
    assert reader.read_tags(motorola) == [("ifd0", 0x0110, "X1", None), ("ifd0", 0x0112, None, 6), ("ifd0", 0x8827, None, None)]
    assert reader.read_tags(tiff(b"II", [(0x0110, 2, 4, b"\0\0\0\0")])) == []
    for junk in (b"", b"\xff\xd8", bytes.fromhex("FFD8FFD9"), bytes.fromhex("FFD8FFE100041234"), b"\x89PNG\r\n", motorola[:20],
                 bytes.fromhex("FFD8FFDA0004"), tiff(b"XX", [])):
        assert reader.read_tags(junk) == []
    other_first = motorola[:2] + bytes.fromhex("FFE000040000") + motorola[2:]
    assert reader.read_tags(other_first) == reader.read_tags(motorola)


def test_summary_labels(spark):
    tags = spark.createDataFrame(
        [(1, "ifd0", 0x010F, "Acme", None), (1, "ifd0", 0x0110, "Z", None), (1, "ifd0", 0x0132, "2001", None),
         (1, "exif", 0x9003, "2000", None), (1, "ifd0", 0x0112, None, 6), (1, "gps", 1, None, None),
         (2, "ifd0", 0x0112, None, 1), (2, "ifd0", 0x0132, "2002", None)], schemas.EXIF_TAGS)
    got = sorted((r.image_id, r.ord, r.label, r.value) for r in E.exif_summary(tags).collect())
    assert got == [
        (1, 0, "Camera", "Acme Z"), (1, 1, "Taken", "2000"), (1, 6, "Orientation", "Stored rotated/flipped (EXIF orientation 6)"),
        (1, 7, "GPS location", "Embedded in the file"), (2, 1, "Taken", "2002")]
    assert [(r.image_id, r.orientation) for r in E.orientations(tags).orderBy("image_id").collect()] == [(1, 6), (2, 1)]


def test_scan_skips_other_files(spark):
    good = tiff(b"II", [(0x010F, 2, 4, b"Abc\0")])
    rows = [(1, "image/jpeg", bytearray(good)), (2, "image/png", bytearray(good)), (3, "image/jpeg", bytearray(b"junk"))]
    files = spark.createDataFrame(rows, "image_id bigint, mime string, content binary")
    assert [tuple(r) for r in E.exif_scan(files).collect()] == [(1, "ifd0", 0x010F, "Abc", None)]


def test_stream_appends_only_new_files(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    docs = X.documents(spark, SF)
    docs.filter("doc_id < 50").coalesce(1).write.mode("append").parquet(source)
    run = lambda: stream.incremental_intake(
        stream.file_stream(spark, source, schemas.DOCUMENTS, "*.parquet"), X.as_images, target, log).awaitTermination()
    run()
    assert spark.read.parquet(target).count() == 50
    docs.filter("doc_id < 20").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert spark.read.parquet(target).count() == 70


def test_plugins(spark):
    T.register_tool("double", lambda df, by=2: df.withColumn("id", F.col("id") * by))
    assert [r.id for r in T.chain_tools(spark.range(3), ("double", {}), ("double", {"by": 5})).collect()] == [0, 10, 20]


def test_files_sink(spark, tmp_path):
    odd = [("a b", "x.txt", b"1"), ("a b", ".hidden", b"2"), ("_c/d", "100% +.txt", b"3"), (None, "no folder", None), ("é", "n\u00fc.txt", b"4")]
    df = spark.createDataFrame(odd, "f string, n string, c binary")
    folder = str(tmp_path / "out")
    write = lambda rows: files.write_files(rows, folder, F.col("f"), F.col("n"), F.col("c"), share=1)
    write(df.withColumn("c", F.lit(b"older")))
    write(df.filter("f is not null"))
    got = {(r["folder"], r["name"]): r["text"] for r in files.read_texts(spark, folder).collect()}
    assert got == {("a b", "x.txt"): "1", ("a b", ".hidden"): "2", ("_c/d", "100% +.txt"): "3", ("\0", "no folder"): "older", ("é", "n\u00fc.txt"): "4"}
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"files": 4, "bytes": 4}
    assert not [p for p in (tmp_path / "out").rglob("*") if len(p.name) == 33 and p.name.startswith(".")]
    write(df.filter("false"))
    assert files.read_texts(spark, folder).count() == 5


def test_failed_files_leave_nothing_half_written(spark, tmp_path):
    bad = spark.createDataFrame([("a", "x", 1), ("a", "y", 0)], "f string, n string, k int")
    content = F.when(F.col("k") == 0, F.raise_error(F.lit("no content"))).otherwise(F.lit("whole"))
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps it
        files.write_files(bad.repartition(2, "n"), str(tmp_path / "out"), F.col("f"), F.col("n"), content)
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    writer = files.FilesWriter(str(tmp_path / "again"))

    class Broken:
        def __iter__(self):
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"folder": ["a", "a"], "name": ["x", "y"], "content": [b"whole", 5]})

    with pytest.raises(TypeError):
        writer.write(iter(Broken()))
    writer.abort([])
    assert sorted(p.name for p in (tmp_path / "again").rglob("*") if p.is_file()) in (["x"], [])


def test_work_folder_must_be_shared():
    from rasterloom.functions.scale import refuse_local

    refuse_local("file:/tmp/x", "local[4]")
    refuse_local("hdfs://store/x", "yarn")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            refuse_local("file:/tmp/x", master)


def test_empty_texts_are_read_back(spark, tmp_path):
    rows = [("a b", "x.txt", "one\ntwo"), ("a b", "y%1.txt", ""), ("c", "_z.txt", "\u00e9"), ("c", "x.txt", "")]
    sinks.text_export(spark.createDataFrame(rows, "album string, text_name string, text string"), str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_texts(spark, str(tmp_path / "out")).collect())) == sorted(rows)


def test_stream_of_a_table_in_several_files(spark, tmp_path):
    from rasterloom.plans.job_queries import _stream

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert _stream(spark, str(tmp_path)).count() == docs.count()


def test_even_parts_are_written_where_they_are(spark, tmp_path, monkeypatch):
    """Finding F3: texts are dealt out only where their parts are few or uneven."""
    dealt = []
    texts = spark.range(400).selectExpr("concat('f', id % 3) as album", "concat(id, '.txt') as text_name", "repeat('x', int(id % 50)) as text")
    cores = spark.sparkContext.defaultParallelism
    even, few = texts.repartition(2 * cores), texts.coalesce(1)
    deal = type(texts).repartition
    monkeypatch.setattr(type(texts), "repartition", lambda self, *a: dealt.append(a[0]) or deal(self, *a))
    for df, share, n in ((even, files.SHARE, 0), (few, files.SHARE, 1), (even, 100, 1)):
        dealt.clear()
        out = str(tmp_path / f"{n}-{share}-{df is few}")
        if share == 100:  # one part has nearly all
            df = df.withColumn("text", F.when(F.spark_partition_id() == 0, F.repeat(F.lit("y"), F.lit(9000))).otherwise(""))
        files.write_files(df, out, F.col("album"), F.col("text_name"), F.col("text"), share)
        assert len(dealt) == n
        assert files.read_texts(spark, out).count() == 400
