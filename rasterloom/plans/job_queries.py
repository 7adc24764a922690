"""Registered queries on sources, sinks, metadata, tool chains and the intake stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import schemas
from rasterloom.functions.scale import stored, work_dir
from rasterloom.operators import exif as E
from rasterloom.operators import ocr as O
from rasterloom.operators import pixels_point as P
from rasterloom.operators import planning, plugins
from rasterloom.operators import tools as T
from rasterloom.plans import views as V
from rasterloom.plans.catalog_queries import REASON
from rasterloom.plans.ocr_queries import ALL, _texts
from rasterloom.plans.pixel_queries import SZ, _key_sql, _sepia_sql
from rasterloom.plans.planning_queries import PLAN_CTE, _plan
from rasterloom.sources import fixtures as X
from rasterloom.sources import images as S
from rasterloom.sources import files, png, sinks
from rasterloom.streaming import intake as stream

LABELS = """lab as (select doc_id as image_id, 0 as ord, 'Camera' as label, concat('Cam', cast(doc_id%7 as varchar)) as value from documents
  union all select doc_id, 6, 'Orientation', concat('Stored rotated/flipped (EXIF orientation ', cast(doc_id%9 as varchar), ')') from documents where doc_id%9>1
  union all select doc_id, 7, 'GPS location', 'Embedded in the file' from documents where doc_id%5=0)"""


def _tags(s, d):
    return E.exif_scan(X.exif_files(s, d))


def _strip(s, d):
    """Labelled images are stripped; the audit counts what is left."""
    tags = _tags(s, d)
    chosen = X.images(s, d).join(s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("image_id")), "image_id", "left_semi")
    clean, left = E.strip_metadata(chosen, tags)
    return tags, clean, left


def _audit(s, d):
    tags, _, left = _strip(s, d)
    return E.privacy_audit(E.exif_summary(tags), E.exif_summary(left))


def _scan(s, d):
    folder = work_dir(s, "scan")
    png.write_pngs(X.pixels(s, d), folder)
    return S.scan_images(s, f"{folder}/images")


def _scan_pixels(s, d):
    """The pixels read back from files; the file name is the image number."""
    scanned = _scan(s, d)
    names = scanned.select("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("bigint").alias("number"))
    return S.pixels(scanned).join(names, "image_id").select(
        F.col("number").alias("image_id"), "y", "x", *"rgba", "width", "height")


def _renditions(s, d):
    folder = work_dir(s, "renditions")
    sinks.write_renditions(_plan(s, d), folder)
    return s.read.parquet(folder).select(*planning.column_names())


def _named_texts(s, d):
    named = O.text_names(X.images(s, d).select("image_id", "album", "pos", "file_name"))
    return named.join(_texts(s, d), "image_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def _export(s, d):
    """Written twice into one folder: the second run replaces the files of the first."""
    folder = work_dir(s, "texts")
    named = stored(_named_texts(s, d), "named")
    sinks.text_export(named.withColumn("text", F.lit("older")), folder)
    sinks.text_export(named, folder)
    return files.read_texts(s, folder).select(F.col("folder").alias("album"), F.col("name").alias("text_name"), "text")


def _stream(s, d):
    target, log = work_dir(s, "intake"), work_dir(s, "intake-log")
    arrivals = stream.table_stream(s, d, schemas.DOCUMENTS, "documents.parquet")
    query = stream.incremental_intake(arrivals, X.as_images, target, log)
    query.awaitTermination()
    return s.read.parquet(target).select("image_id", "album", "pos", "file_name", "mime", "size_bytes", "reason", "status")


def _chain(s, d):
    plugins.register_all()
    return T.chain_tools(
        P.with_dims(X.pixels(s, d)),
        ("remove-background", {"color": "#ffffff", "tolerance": 40, "smoothing": 20}),
        ("sepia", {"percent": 75}),
        ("margin", {"all": 2, "color": "#102030", "opacity": 100}),
    )


def _forms(s, d, *steps):
    """A transformation, an iterator kernel and table functions in one chain."""
    plugins.register_all()
    return T.chain_tools(P.with_dims(X.pixels(s, d)), ("sepia", {"percent": 75}), ("tone", {"strength": 2}), ("mask", {"level": 60}), *steps)


TONE = "((({0}*{0}+127)//255)*(({0}*{0}+127)//255)+127)//255"
FORMS = SZ + ", sep as (" + _sepia_sql("sized", 75) + "), toned as (select * replace (" + ", ".join(
    f"cast({TONE.format(c)} as int) as {c}" for c in "rgb") + """) from sep),
  masked as (select *, case when (299*r+587*g+114*b)//1000 >= 60 then 255 else 0 end as mask from toned)"""

QUERIES = {
    "exif_scan": (
        _tags,
        """select doc_id as image_id, 'ifd0' as ifd, 271 as tag, concat('Cam', cast(doc_id%7 as varchar)) as text, null::bigint as num from documents
          union all select doc_id, 'ifd0', 274, null, doc_id%9 from documents union all select doc_id, 'ifd0', 34853, null, case when doc_id%5=0 then 56 else 256 end from documents
          union all select doc_id, 'gps', 1, null, 1 from documents where doc_id%5=0"""),
    "exif_summary": (lambda s, d: E.exif_summary(_tags(s, d)), "with " + LABELS + " select * from lab"),
    "privacy_audit": (
        _audit,
        "with " + LABELS + """ select label, count(*) as images_before, count(*) filter (image_id not in (select doc_id from labels)) as images_after from lab group by 1"""),
    "strip_metadata": (
        lambda s, d: _strip(s, d)[1].select("image_id", "file_name", "mime", "width", "height"),
        V.cte(V.IMAGES) + "select image_id, file_name, mime, width, height from images where image_id in (select doc_id from labels)"),
    "scan_images": (_scan_pixels, SZ + "select image_id, y, x, r, g, b, a, width, height from sized"),
    "write_renditions": (_renditions, PLAN_CTE + "select * from rendition_plan"),
    "text_export": (
        _export,
        ALL.rstrip() + ", " + V.IMAGES + """, t as (select album, image_id, pos, regexp_replace(file_name,'\\.[^/.]+$','') as stem from images),
          k as (select *, row_number() over (partition by album, stem order by pos) as k from t)
          select album, case when k=1 then concat(stem,'.txt') else concat(stem,'-',cast(k as varchar),'.txt') end as text_name, coalesce(text,'') as text
          from k left join texts using (image_id)"""),
    "text_archives": (
        lambda s, d: sinks.text_archives(X.images(s, d)),
        V.cte(V.IMAGES) + "select album, count(*) as n_texts, concat('album-ocr-', cast(count(*) as varchar), '-texts.zip') as archive_name from images group by 1"),
    "incremental_intake": (
        _stream,
        V.cte(V.IMAGES) + f"""select image_id, album, pos, file_name, mime, size_bytes, {REASON} as reason,
          case when ({REASON})='too_large' then 413 when ({REASON}) is not null then 400 end as status from images"""),
    "chain_tools_forms": (_forms, FORMS + " select image_id, y, x, r, g, b, a, width, height, mask from masked join dims using (image_id)"),
    "chain_tools_strips": (
        lambda s, d: _forms(s, d, ("strips", {"height": 8})),
        FORMS + " select image_id, y//8 as strip, count(*) filter (mask=255) as bright from masked group by 1, 2"),
    "chain_tools": (
        _chain,
        SZ + "," + _key_sql((255, 255, 255), 40, 20) + ", sep as (" + _sepia_sql("keyed", 75) + """),
          c as (select image_id, width, height, y, unnest(range(width+4)) as x from (select *, unnest(range(height+4)) as y from dims))
          select c.image_id, cast(c.y as int) as y, cast(c.x as int) as x, coalesce(r,16) as r, coalesce(g,32) as g, coalesce(b,48) as b, coalesce(a,255) as a, c.width+4 as width, c.height+4 as height
            from c left join sep p on p.image_id=c.image_id and p.y+2=c.y and p.x+2=c.x"""),
}
