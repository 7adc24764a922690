"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

IMAGES = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("album", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

PIXELS = "image_id bigint, y int, x int, r int, g int, b int, a int"
SIZED_PIXELS = PIXELS + ", width int, height int"
EXIF_TAGS = "image_id bigint, ifd string, tag int, text string, num bigint"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DETECTIONS = (
    "image_id bigint, pass int, seq int, level int, text string, conf string, "
    "left_px int, top_px int, width_px int, height_px int"
)
