"""Registered queries on plans, chaining, layouts, budgets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions.scale import numbered, pos_block
from rasterloom.operators import catalog as C
from rasterloom.operators import exif as E
from rasterloom.operators import intake as I
from rasterloom.operators import planning as P
from rasterloom.operators import runner as R
from rasterloom.plans import views as V
from rasterloom.plans.catalog_queries import REASON, SIZE_LABEL, _half, _one
from rasterloom.sources import fixtures as X

IMG = V.cte(V.IMAGES)

# Per tool: defaults, edges of the settings, and settings that are refused.
RECIPES = [
    ("whole", "resize", {}),
    ("turn", "resize", {"rotate": "90"}),
    ("cut", "resize", {"rotate": "270", "cropX": "0.1", "cropY": "0.25", "cropWidth": "0.5", "cropHeight": "0.6"}),
    ("cut-wide", "resize", {"cropX": "0.5", "cropWidth": "0.9", "width": "640.4"}),
    ("scale-half", "scale", {}),
    ("scale-most", "scale", {"percent": "200"}),
    ("scale-fit", "scale", {"mode": "fit", "fitWidth": "800", "fitHeight": "600"}),
    ("scale-500", "scale", {"percent": "500", "fitWidth": "15"}),
    ("webp", "convert", {"format": "image/webp"}),
    ("icon", "convert", {"format": "image/x-icon", "size": "300"}),
    ("svg", "convert-svg", {}),
    ("compressed", "compress", {}),
    ("small", "compress", {"maxSize": "1000", "quality": "95"}),
    ("fit-500", "compress", {"mode": "target"}),
    ("fit-10", "compress", {"mode": "target", "targetKb": "10", "maxSize": "320"}),
    ("fit-1", "compress", {"mode": "target", "targetKb": "1", "quality": "9"}),
    ("clean", "strip-metadata", {}),
    ("cutout", "remove-background", {"tolerance": "18"}),
    ("cutout-0", "remove-background", {"tolerance": "0"}),
    ("warm", "adjust", {"sepia": "100"}),
    ("dark", "adjust", {"brightness": "-1", "blur": "many"}),
    ("frame", "margin", {"unit": "percent", "all": "10", "opacity": "50"}),
    ("edge", "margin", {"linked": "false", "top": "1", "right": "2", "bottom": "3", "left": "4"}),
    ("frame-120", "margin", {"opacity": "120"}),
    ("stack", "merge", {}),
    ("row", "merge", {"direction": "horizontal"}),
    ("stack-fill", "merge", {"resize": "fill"}),
    ("row-fill", "merge", {"direction": "horizontal", "resize": "fill", "alignment": "end"}),
    ("big", "upscale", {}),
    ("text", "ocr", {}),
    ("text-none", "ocr", {"lang": ""}),
    ("glow", "sparkle", {}),
]


def recipes(spark):
    return spark.createDataFrame(RECIPES, "recipe_id string, tool_id string, params map<string,string>")


DUCK_RECIPES = "recipes as (select * from (values " + ", ".join(f"('{r}','{t}')" for r, t, _ in RECIPES) + ") q(recipe_id, tool_id))"
KEEP = "case when mime in ('image/jpeg','image/png','image/webp') then mime else 'image/png' end"

def _crop(side, at, part):
    start = f"greatest(0,least({_half(f'{side}*{at}::double')},{side}-1))"
    return f"greatest(1,least({_half(f'{side}*{part}::double')},{side}-{start}))"


def _bisected(rows, key):
    """The search replayed over a list of sizes, step by step: rung ``b7`` for rows with ``sizes`` and ``budget``."""
    steps = [f"b0 as (select {key}, budget, sizes, 0 as lo0, 128 as hi0, 0 as b0 from {rows})"]
    for i in range(1, 8):
        low, high, mid = f"lo{i - 1}", f"hi{i - 1}", f"((lo{i - 1}+hi{i - 1})//2)"
        fits = f"sizes[{mid}+1]<=budget"
        steps.append(f"""b{i} as (select {key}, budget, sizes, case when {fits} then {mid} else {low} end as lo{i}, case when {fits} then {high} else {mid} end as hi{i},
          case when {fits} then {mid} else b{i - 1} end as b{i} from b{i - 1})""")
    return ",\n".join(steps)


SHRUNK = lambda side, top: f"case when width<={top} and height<={top} then {side} else {_half(f'{side}*({top}::double/greatest(width,height))')} end"
PLAN = f"""ladders as (select image_id, list(size_bytes order by k) as sizes from rungs group by 1),
aimed as (select image_id, recipe_id, budget, sizes from ladders, (values ('fit-500', 512000), ('fit-10', 10240)) t(recipe_id, budget)),
{_bisected("aimed", "image_id, recipe_id")},
j as (select i.*, r.recipe_id, r.tool_id, t.suffix, t.out_ext, b7, sizes[b7+1]<=budget as met,
    regexp_replace(file_name, '\\.[^/.]+$', '') as stem,
    case when recipe_id='webp' then 'image/webp' when recipe_id='icon' then 'image/x-icon' when recipe_id='svg' then 'image/svg+xml'
      when recipe_id='text' then 'text/plain' when recipe_id in ('cutout','big','frame') then 'image/png' else {KEEP} end as out_mime
  from images i join accepts a using (mime) join tools t using (tool_id) join recipes r using (tool_id) left join b7 using (image_id, recipe_id)
  where tool_id<>'merge' and recipe_id not in ('scale-500','fit-1','cutout-0','dark','frame-120','text-none')),
ext as (select *, coalesce(out_ext, case out_mime when 'image/jpeg' then 'jpg' when 'image/png' then 'png' when 'image/webp' then 'webp' when 'image/x-icon' then 'ico' end) as ext,
    least(width,height)*10.0::double/100 as pc, 0.05::double+(case when out_mime='image/png' then 1.0::double else 0.95::double end-0.05::double)*b7/128.0::double as found from j),
dimmed as (select *, {", ".join(f"greatest(1, {SHRUNK(c, 1600)}) as {c[0]}1600, greatest(1, {SHRUNK(c, 320)}) as {c[0]}320" for c in ("width", "height"))} from ext),
sized_plan as (select image_id, album, pos, recipe_id, tool_id,
  cast(case recipe_id when 'scale-half' then {_one('width*(50/100.0::double)')} when 'scale-most' then width*2 when 'scale-fit' then {_one('width*least(800::double/width,600::double/height,1.0::double)')}
    when 'icon' then 256 when 'compressed' then w1600 when 'small' then greatest(1, {SHRUNK('width', 1000)})
    when 'fit-500' then case when out_mime='image/png' then {_one('w1600*found')} else w1600 end when 'fit-10' then case when out_mime='image/png' then {_one('w320*found')} else w320 end
    when 'frame' then width+2*greatest(0,{_half('pc')}) when 'edge' then width+6 when 'big' then width*4 when 'turn' then height when 'cut' then {_crop('height', 0.1, 0.5)} when 'cut-wide' then 640 else width end as bigint) as out_width,
  cast(case recipe_id when 'scale-half' then {_one('height*(50/100.0::double)')} when 'scale-most' then height*2 when 'scale-fit' then {_one('height*least(800::double/width,600::double/height,1.0::double)')}
    when 'icon' then 256 when 'compressed' then h1600 when 'small' then greatest(1, {SHRUNK('height', 1000)})
    when 'fit-500' then case when out_mime='image/png' then {_one('h1600*found')} else h1600 end when 'fit-10' then case when out_mime='image/png' then {_one('h320*found')} else h320 end
    when 'frame' then height+2*greatest(0,{_half('pc')}) when 'edge' then height+4 when 'big' then height*4 when 'turn' then width when 'cut' then {_crop('width', 0.25, 0.6)} else height end as bigint) as out_height,
  out_mime, case when tool_id='ocr' then concat(stem,'.txt') else concat(stem,'-',case when recipe_id='icon' then 'icon' else suffix end,'.',ext) end as out_name,
  case when tool_id<>'compress' then null when out_mime='image/png' and b7 is not null then 'scale' else 'quality' end as knob,
  case recipe_id when 'compressed' then 0.75::double when 'small' then 0.95::double else found end as setting, met as fits,
  case when tool_id in ('convert-svg','upscale','ocr') and size_bytes=0 then 'empty' when tool_id in ('convert-svg','upscale','ocr') and size_bytes>10*1024*1024 then 'too_large'
    when tool_id='upscale' and greatest(width,height)>1500 then 'side_too_long' end as reason
  from dimmed),
members as (select *, max(width) over (partition by album) as mw, max(height) over (partition by album) as mh from images where mime<>'image/gif'),
canvas as (select album, count(*) as files, max(width) as mw, max(height) as mh, sum(width) as sw, sum(height) as sh,
    sum({_one('width*(mh::double/height)')}) as fw, sum({_one('height*(mw::double/width)')}) as fh from members group by 1),
merged as (select album, recipe_id, files, case recipe_id when 'row' then sw when 'row-fill' then fw else mw end as w, case recipe_id when 'stack' then sh when 'stack-fill' then fh else mh end as h
  from canvas, (values ('stack'), ('row'), ('stack-fill'), ('row-fill')) m(recipe_id)),
rendition_plan as (select 'image' as grain, * replace (case when reason is null then out_width end as out_width, case when reason is null then out_height end as out_height,
    case when reason is null then round(setting, 9) end as setting), null::varchar as failed from sized_plan
  union all by name select 'album' as grain, null::bigint as image_id, album, null::int as pos, recipe_id, 'merge' as tool_id, cast(case when files>1 then w end as bigint) as out_width,
    cast(case when files>1 then h end as bigint) as out_height, 'image/png' as out_mime, 'merged.png' as out_name, case when files<2 then 'too_few_files' end as reason from merged
  union all by name select 'recipe' as grain, recipe_id, tool_id, reason, failed from (values ('scale-500','scale','invalid_settings','fitWidth,percent'), ('fit-1','compress','invalid_settings','quality,targetKb'),
    ('cutout-0','remove-background','invalid_settings','tolerance'), ('dark','adjust','invalid_settings','blur,brightness'), ('frame-120','margin','invalid_settings','opacity'),
    ('text-none','ocr','invalid_settings','lang'), ('glow','sparkle','unknown_tool',null)) v(recipe_id, tool_id, reason, failed))"""
PLAN_CTE = V.cte(V.IMAGES, V.RUNGS, V.TOOLS, DUCK_RECIPES, PLAN)


def _plan(s, d, max_broadcast=P.BROADCAST_ROWS):
    plan = P.rendition_plan(X.spread(X.images(s, d)), recipes(s), X.rungs(s, d), max_broadcast)
    return plan.withColumn("setting", F.round("setting", 9))


def _small_albums(s, d):
    """Albums so small that some hold a single accepted image, planned without measured sizes."""
    images = X.images(s, d).withColumn("album", F.concat("album", F.lit("/"), (F.col("image_id") % 23).cast("string")))
    return P.rendition_plan(images, recipes(s)).filter("grain = 'album' or reason = 'not_measured'").select(
        "grain", "image_id", "album", "recipe_id", "out_width", "out_height", "reason")


def _keyed(s, d):
    """Plan rows with the key of their input and settings (the text stands in for the file)."""
    content = X.documents(s, d).select(F.col("doc_id").alias("image_id"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    settings = F.broadcast(recipes(s).select("recipe_id", "params"))
    return (
        _plan(s, d).select("image_id", "recipe_id", "tool_id").join(content, "image_id").join(settings, "recipe_id")
        .withColumn("work_key", P.plan_key(F.col("crc"), F.col("params"))).drop("params", "crc")
    )


def _incremental(s, d):
    """Labelled images are finished, but those labelled toxic were finished with old settings."""
    plan = _keyed(s, d)
    labels = s.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id as image_id", "toxic")
    finished = plan.join(labels, "image_id").withColumn(
        "work_key", F.when(F.col("toxic") == 1, F.lit("older settings")).otherwise(F.col("work_key")))
    return P.incremental_plan(plan, finished).select("image_id", "recipe_id", "tool_id")


def _outputs(s, d):
    return X.images(s, d).select("image_id", "album", "pos", "file_name", "mime", "size_bytes", "width", "height")


def _album_types(s, d):
    """Albums of one source and language, so that some hold only accepted types."""
    return X.images(s, d).withColumn("album", F.concat("album", F.lit("/"), (F.col("image_id") % 7).cast("string")))


LAYOUT_CTE = V.cte(V.IMAGES, """q as (select album, image_id, pos, width, height, max(width) over (partition by album) as mw, max(height) over (partition by album) as mh from images)""")


def _layout(s, d, *args):
    return P.merge_layout(X.images(s, d), *args).select(
        "album", "image_id", "draw_width", "draw_height", "place_x", "place_y", "canvas_width", "canvas_height")


def _duck_layout(horizontal, align, fill):
    cross, main, target = ("height", "width", "mh") if horizontal else ("width", "height", "mw")
    dw = _one(f"width*({target}::double/{cross})") if fill else "width"
    dh = _one(f"height*({target}::double/{cross})") if fill else "height"
    free = f"({target}-draw_{cross})"
    off = {"start": "0", "center": _half(free + "/2.0::double"), "end": free}[align]
    along, across = ("x", "y") if horizontal else ("y", "x")
    return LAYOUT_CTE + f""", r as (select *, cast({dw} as bigint) as draw_width, cast({dh} as bigint) as draw_height from q)
      select album, image_id, draw_width, draw_height,
        cast(coalesce(sum(draw_{main}) over (partition by album order by pos rows between unbounded preceding and 1 preceding),0) as bigint) as place_{along},
        cast({off} as bigint) as place_{across}, cast(sum(draw_{main}) over (partition by album) as bigint) as canvas_{main}, cast({target} as bigint) as canvas_{cross} from r"""


BUDGET = V.cte(V.IMAGES, V.RUNGS, f"""t as (select image_id, size_bytes*2//3 as budget, sizes from images
  join (select image_id, list(size_bytes order by k) as sizes from rungs group by 1) using (image_id)),
{_bisected("t", "image_id")},
s7 as (select * from b7 join (select image_id, mime from images) using (image_id))""")

ARCHIVE = V.cte(V.IMAGES, """n as (select i.album, i.image_id, i.pos, case when k=1 then file_name else concat(substr(file_name,1,nn), '-', cast(k as varchar), substr(file_name,nn+1)) end as unique_name, bytes from
  (select *, row_number() over (partition by album, file_name order by pos) as k,
     case when contains(file_name,'.') then length(file_name)-position('.' in reverse(file_name)) else length(file_name) end as nn from images) i
  join (select doc_id, octet_length(encode(text)) as bytes from documents) b on b.doc_id=i.image_id)""")


# CRC-32 byte by byte, with its table of 256 values made by its rule.
CHECKSUMS = """with recursive rounds as (select i as byte, i as v, 0 as n from range(256) r(i)
  union all select byte, case when v&1=1 then xor(v>>1, 3988292384) else v>>1 end, n+1 from rounds where n<8),
tab as (select list(v order by byte) as t from rounds where n=8),
hexed as (select doc_id, source, hex(encode(text)) as h from documents),
bytes as (select doc_id, source, list_transform(range(length(h)//2), lambda i: cast(concat('0x', substr(h, 2*i+1, 2)) as bigint)) as bs from hexed)
select source as album, doc_id as image_id,
  xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c>>8, t[xor(c&255, b)+1])), 4294967295) as crc from bytes, tab"""


def _entries(s, d):
    content = P.measured(X.documents(s, d).select(F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("content")))
    return C.dedupe_names(X.images(s, d)).select("album", "image_id", "pos", "unique_name").join(content, "image_id")


MESSAGE = """case reason when 'unsupported_type' then 'Unsupported image type. Use PNG, JPEG, or WebP.'
  when 'empty' then 'Empty upload.' when 'too_large' then 'Image exceeds the 10 MB limit.' end"""
RUN = V.cte(V.IMAGES, f"run as (select *, reason is null as ok, {MESSAGE} as message from (select *, {REASON} as reason from images))")

REPORT = """f as (select album, count(*) as total, count(*) filter (not ok) as failed,
    list({'n': file_name, 'm': message} order by pos) filter (not ok) as fl from run group by 1)
  select album, total, failed, case when failed=0 then '' when total=1 then fl[1].m else
    concat(cast(failed as varchar),' of ',cast(total as varchar),' images failed (',array_to_string(list_transform(fl[1:3], lambda z: z.n), ', '),
    case when failed>3 then concat(' and ',cast(failed-3 as varchar),' more') else '' end, '): ', fl[1].m) end as report from f"""

# JPEG files around whole texts: a metadata segment, then image data. Some end too early, some are no JPEG files.
HEAD = "'FFD8FFE10050457869660000' || rpad('', 144, '0')"
BODY, TAIL = "'FFDA0008010100003F00'", "'FFD9'"
SPARK_FILE = f"""case when doc_id%6=5 then concat(unhex({HEAD}), unhex({BODY}), cast(text as binary)) when doc_id%10=3 then concat(unhex('00'), cast(text as binary))
  else concat(unhex({HEAD}), unhex({BODY}), cast(text as binary), unhex({TAIL})) end as content"""
ATTEMPT = V.cte(V.IMAGES, f"""made as (select doc_id as image_id, unhex('FFD8') || unhex({BODY}) || encode(coalesce(text,'')) || unhex({TAIL}) as made from documents),
  run as (select *, message is null as ok from (select i.*, made, coalesce({MESSAGE}, case when image_id%6=5 then 'The image ends too early.' when image_id%10=3 then 'The image could not be decoded.' end) as message
    from (select *, {REASON} as reason from images) i join made using (image_id)))""")


def _attempted(s, d):
    """Metadata removed from every file that can be read."""
    files = X.as_images(X.documents(s, d), SPARK_FILE)
    return P.batch_run(
        R.in_byte_shares(files, F.octet_length("content")), "strip-metadata", E.metadata_remover, "output binary, out_bytes int", "The metadata could not be removed.")


QUERIES = {
    "rendition_plan": (_plan, PLAN_CTE + "select * from rendition_plan"),
    # The route of a recipe table too large to broadcast, forced.
    "rendition_plan_salted": (
        lambda s, d: _plan(s, d, 0), PLAN_CTE + "select * from rendition_plan"),
    "rendition_plan_albums": (
        _small_albums,
        PLAN_CTE.replace("source as album", "concat(source,'/',cast(doc_id%23 as varchar)) as album") + """select grain, image_id, album, recipe_id, out_width, out_height, reason from rendition_plan where grain='album'
          union all select grain, image_id, album, recipe_id, null, null, 'not_measured' from rendition_plan where recipe_id in ('fit-500','fit-10')"""),
    "compress_plan": (
        lambda s, d: P.compress_plan(X.images(s, d), 1000, 72).select(
            "image_id", "out_width", "out_height", "encoder_quality", "out_mime", "out_name"),
        IMG + f"""select image_id, case when width<=1000 and height<=1000 then width else {_half('width*(1000::double/greatest(width,height))')} end as out_width,
          case when width<=1000 and height<=1000 then height else {_half('height*(1000::double/greatest(width,height))')} end as out_height,
          0.72::double as encoder_quality, {KEEP} as out_mime, concat(regexp_replace(file_name,'\\.[^/.]+$',''),'-compressed.',
          case mime when 'image/jpeg' then 'jpg' when 'image/webp' then 'webp' else 'png' end) as out_name from images""",
    ),
    "incremental_plan": (
        _incremental,
        PLAN_CTE + """select image_id, recipe_id, tool_id from rendition_plan
          where image_id not in (select doc_id from labels where toxic is distinct from 1)""",
    ),
    "chain_targets_album": (
        lambda s, d: P.chain_targets_album(_album_types(s, d), "scale"),
        V.cte(V.IMAGES, V.TOOLS) + """, o as (select distinct concat(album,'/',cast(image_id%7 as varchar)) as album, mime from images)
          select a.album, t.tool_id from (select distinct album from o) a, tools t where t.batch and t.tool_id<>'scale'
          and not exists (select 1 from o where o.album=a.album and o.mime not in (select mime from accepts c where c.tool_id=t.tool_id))""",
    ),
    "chain_targets_single": (
        lambda s, d: P.chain_targets_single(_outputs(s, d), "scale"),
        V.cte(V.IMAGES, V.TOOLS) + "select image_id, tool_id from images join accepts using (mime) where tool_id<>'scale'",
    ),
    "album_totals": (
        lambda s, d: P.album_totals(_outputs(s, d)),
        IMG + """, t as (select album, count(*) as n_outputs, cast(sum(size_bytes) as bigint) as total_bytes from images group by 1)
          select *, concat('album-', cast(n_outputs as varchar), '-images.zip') as archive_name, """ + SIZE_LABEL.format("total_bytes") + " as total_label from t",
    ),
    "distinct_types": (
        lambda s, d: P.distinct_types(_outputs(s, d)),
        IMG + "select distinct album, mime from images",
    ),
    "preview_top4": (
        lambda s, d: P.preview_top4(_outputs(s, d)).select("album", "image_id", "preview_pos"),
        IMG + """select album, image_id, preview_pos from (select *, cast(row_number() over (partition by album order by pos) as int) as preview_pos
          from images) where preview_pos<=4""",
    ),
    "batch_run": (
        lambda s, d: P.batch_run(_outputs(s, d)).select("image_id", "album", "pos", "ok", "message"),
        RUN + "select image_id, album, pos, ok, message from run",
    ),
    "batch_run_upscale": (
        lambda s, d: P.batch_run(_outputs(s, d), "upscale").select("image_id", "album", "pos", "ok", "message"),
        RUN + """select image_id, album, pos, ok and greatest(width,height)<=1500 as ok, coalesce(message, case when greatest(width,height)>1500
          then 'Image is too large to upscale. The longest side must be at most 1500px.' end) as message from run""",
    ),
    "batch_attempt": (
        lambda s, d: _attempted(s, d).select("image_id", "album", "pos", "ok", "message", "out_bytes", F.sha2("output", 256).alias("out_sha256")),
        ATTEMPT + """select image_id, album, pos, ok, message, case when ok then octet_length(made) end as out_bytes, case when ok then sha256(made) end as out_sha256 from run"""),
    "batch_failures": (
        lambda s, d: numbered(R.settle(_attempted(s, d), ["output", "out_bytes"])[1], ["album"], ["pos"], pos_block(), "place").select("album", "place", "file_name", "message"),
        ATTEMPT + "select album, row_number() over (partition by album order by pos) as place, file_name, message from run where not ok"),
    "batch_renditions": (
        lambda s, d: R.settle(_attempted(s, d), ["output", "out_bytes"])[0].groupBy("album").agg(
            F.count("*").alias("files"), F.sum("out_bytes").alias("bytes")),
        ATTEMPT + "select album, count(*) as files, cast(sum(octet_length(made)) as bigint) as bytes from run where ok group by 1"),
    "batch_attempt_report": (
        lambda s, d: P.batch_report(_attempted(s, d)), ATTEMPT[: -1] + "," + REPORT),
    "batch_report": (
        lambda s, d: P.batch_report(P.batch_run(_outputs(s, d))),
        RUN[: -1] + "," + REPORT,
    ),
    "merge_layout": (
        lambda s, d: _layout(s, d, "vertical", "center", "none"), _duck_layout(False, "center", False)),
    "merge_layout_fill": (
        lambda s, d: _layout(s, d, "horizontal", "end", "fill"), _duck_layout(True, "end", True)),
    "merge_layout_blocks": (
        lambda s, d: _layout(s, d, "horizontal", "start", "none", 64), _duck_layout(True, "start", False)),
    "budget_search": (
        lambda s, d: P.budget_search(X.images(s, d), X.rungs(s, d), F.expr("size_bytes*2 div 3")).selectExpr(
            "image_id", "k", "size_at_k", "round(setting,9) as setting", "knob", "fits"),
        BUDGET + """select image_id, b7 as k, sizes[b7+1] as size_at_k,
          round(0.05::double+(case when mime in ('image/jpeg','image/webp') then 0.95::double else 1.0::double end-0.05::double)*b7/128.0::double,9) as setting,
          case when mime in ('image/jpeg','image/webp') then 'quality' else 'scale' end as knob, sizes[b7+1]<=budget as fits from s7""",
    ),
    "budget_search_monotone": (
        lambda s, d: P.budget_search_monotone(
            X.images(s, d), X.rungs(s, d).select("image_id", "k").join(
                X.rungs(s, d).groupBy("image_id").agg(F.max("size_bytes").alias("top")).hint("shuffle_hash"), "image_id").selectExpr("image_id", "k", "top*(k+1) div 128 as size_bytes"),
            F.expr("size_bytes*2 div 3")).select("image_id", "k"),
        V.cte(V.IMAGES, V.RUNGS) + """, m as (select image_id, k, max(size_bytes) over (partition by image_id)*(k+1)//128 as sz from rungs)
          select i.image_id, coalesce(max(k) filter (sz<=size_bytes*2//3 and k>=1),0) as k from images i join m using (image_id) group by 1""",
    ),
    "archive_manifest": (
        lambda s, d: P.archive_entries(_entries(s, d)).select("album", "image_id", "unique_name", "entry_bytes", "header_offset"),
        ARCHIVE + """select album, image_id, unique_name, cast(bytes as int) as entry_bytes, cast(coalesce(sum(30+octet_length(encode(unique_name))+bytes)
          over (partition by album order by pos rows between unbounded preceding and 1 preceding),0) as bigint) as header_offset from n""",
    ),
    "archive_checksums": (
        lambda s, d: P.archive_entries(_entries(s, d)).select("album", "image_id", "crc"), CHECKSUMS),
    "archive_totals": (
        lambda s, d: P.archive_totals(P.archive_entries(_entries(s, d)), X.images(s, d)),
        ARCHIVE + """select album, count(*) as n_entries, cast(sum(30+octet_length(encode(unique_name))+bytes) as bigint) as directory_offset,
          cast(sum(46+octet_length(encode(unique_name))) as bigint) as directory_bytes,
          cast(sum(76+2*octet_length(encode(unique_name))+bytes)+22 as bigint) as archive_bytes from n group by 1""",
    ),
}

# the accepted part of an intake and the set operations of the guard
QUERIES["intake_accepted"] = (
    lambda s, d: I.accepted(I.intake_guard(X.images(s, d))).select("image_id", "album", "file_name"),
    IMG + f"select image_id, album, file_name from images where ({REASON}) is null",
)
