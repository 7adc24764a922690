"""Image-shaped tables derived from the given ``documents`` and ``embeddings`` tables.

Each function has its DuckDB twin in ``plans/views.py``. All of them are projections and
explodes of a scan, so they keep the partitioning of the files they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom import schemas


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a source of few splits, before rows are exploded; else leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows; ``pos`` is the document number, so no global numbering is needed."""
    return as_images(documents(spark, sf_dir))


def as_images(docs: DataFrame, *more: str) -> DataFrame:
    """Catalogue rows of documents, with further columns given as SQL."""
    return docs.selectExpr(
        "doc_id as image_id",
        "source as album",
        "cast(doc_id as int) as pos",
        """concat(case when doc_id%11=0 then 'scan' else concat('img', cast(doc_id%300 as string)) end,
             case when doc_id%13=0 then '' when doc_id%4=0 then '.jpg' when doc_id%4=1 then '.png'
                  when doc_id%4=2 then '.webp' else '.gif' end) as file_name""",
        """case when doc_id%4=0 then 'image/jpeg' when doc_id%4=1 then 'image/png'
                when doc_id%4=2 then 'image/webp' else 'image/gif' end as mime""",
        "cast(16+(doc_id*373)%4001 as int) as width",
        "cast(16+(doc_id*911)%3001 as int) as height",
        "cast(case when doc_id%17=0 then 0 else n_chars*1024 end as bigint) as size_bytes",
        *more,
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel; 16 vectors of 64 floats make one 32 x 32 image.

    Flat art where ``image_id % 3 = 0``, alpha below 255 in odd images.
    """
    return (
        spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        .selectExpr("vec_id", "embedding", "posexplode(embedding) as (p, v)")
        .selectExpr("vec_id", "p", "v", "embedding[size(embedding)-1-p] as v2")
        .selectExpr(
            "vec_id",
            "p",
            "cast(floor(vec_id/16) as bigint) as image_id",
            "floor((least(greatest(cast(v as double)*3,-1D),1D)+1)*127.5D) as r0",
            "floor((least(greatest(cast(v2 as double)*3,-1D),1D)+1)*127.5D) as g0",
        )
        .selectExpr(
            "image_id",
            "cast((vec_id%16)*2+floor(p/32) as int) as y",
            "cast(p%32 as int) as x",
            "cast(case when image_id%3=0 then floor(r0/128)*128 else r0 end as int) as r",
            "cast(case when image_id%3=0 then floor(g0/128)*128 else g0 end as int) as g",
            "cast(case when image_id%3=0 then 0 else (vec_id*37+p*11)%256 end as int) as b",
            "cast(case when image_id%2=0 then 255 else 255-(p%5)*20 end as int) as a",
        )
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of all vectors: eight of them make a line of 512 pixels, in few colours."""
    return (
        spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        .selectExpr("vec_id", "posexplode(embedding) as (p, v)")
        .selectExpr("vec_id", "p", "floor((least(greatest(cast(v as double)*3,-1D),1D)+1)*127.5D) as r0")
        .selectExpr(
            "0L as image_id", "cast(vec_id div 8 as int) as y", "cast((vec_id%8)*64+p as int) as x", "cast(floor(r0/32)*32 as int) as r",
            "cast(floor(r0/128)*128 as int) as g", "0 as b", "cast(case when vec_id%3=0 then 255 else 128 end as int) as a")
    )


def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured size at each of the 128 steps of the budget ladder."""
    return (
        spread(documents(spark, sf_dir).select("doc_id", "n_chars"))
        .selectExpr("doc_id", "n_chars", "explode(sequence(0,127)) as k")
        .selectExpr(
            "doc_id as image_id",
            "cast(k as int) as k",
            """cast(floor(n_chars*1024*(k+1)/128)
                 + case when doc_id%5=0 then ((k*37)%11)*n_chars else 0 end as bigint) as size_bytes""",
        )
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recogniser output over the whole text: two passes whose boxes partly overlap."""
    words = (
        spread(documents(spark, sf_dir).select("doc_id", "text"))
        .selectExpr("doc_id", "filter(split(text, '[ \\\\n\\\\t\\\\r]+'), z -> z<>'') as ws")
        # the outer form keeps the optimizer from splitting every text a second time in a filter
        .selectExpr("doc_id", "posexplode_outer(ws) as (i, w)")
        .filter("i is not null")
        .selectExpr("doc_id", "i", "w", "length(w) as n")
    )
    # both passes come from one scan: each word is exploded into its one or two detections
    return words.selectExpr(
        "doc_id", "i", "w", "n", "explode(if(i%3<>1, array(0,1), array(0))) as pass"
    ).selectExpr(
        "doc_id as image_id",
        "pass",
        "cast(i as int) as seq",
        "case when pass=0 and i%23=22 then 4 else 5 end as level",
        "case when pass=1 then w when i%29=28 then '  ' else concat(w, ' ') end as text",
        """case when pass=1 then cast(((doc_id*31+i*17)%101*7+13)%101 as string)
                when i%31=30 then 'n/a' else cast((doc_id*31+i*17)%101 as string) end as conf""",
        "cast((i%10)*90 + if(pass=1, (i%5)*4, 0) as int) as left_px",
        "cast(floor(i/10)*22+(i*7)%4 + if(pass=1, i%3, 0) as int) as top_px",
        "cast(8*n as int) as width_px",
        "16 as height_px",
    )


def ocr_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes for the detections: 900 wide, and 0 x 0 for some (failed header reads)."""
    return documents(spark, sf_dir).selectExpr(
        "doc_id as image_id",
        "cast(if(doc_id%19=0, 0, 900) as int) as width",
        "cast(if(doc_id%19=0, 0, 160+n_chars*4) as int) as height",
    )


def exif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG headers with a known tag directory, one per document."""
    return documents(spark, sf_dir).selectExpr(
        "doc_id as image_id",
        "'image/jpeg' as mime",
        """unhex(concat('FFD8', 'FFE1', '0050', '457869660000', '49492A0008000000', '0300',
             '0F010200', '05000000', '32000000',
             '12010300', '01000000', lpad(hex(doc_id%9),2,'0'), '000000',
             '25880400', '01000000', case when doc_id%5=0 then '38000000' else '00010000' end,
             '00000000', hex(concat('Cam', cast(doc_id%7 as string))), '00', '00',
             '0100', '01000300', '01000000', '01000000', '0000', 'FFD9')) as content""",
    )
