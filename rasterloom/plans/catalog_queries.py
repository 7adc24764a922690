"""Registered queries on the catalogue: intake, names, sizes, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import catalog as C
from rasterloom.operators import intake as I
from rasterloom.plans import views as V
from rasterloom.sources import fixtures as X

IMG = V.cte(V.IMAGES)

# request columns derived from the catalogue, the same text in both engines
TRACE_REQUEST = [
    "image_id",
    "case when image_id%9=0 then 'fast' when image_id%2=0 then 'auto' else 'manual' end as preset",
    "case when image_id%13=0 then 'mesh' when image_id%3=0 then 'spline' when image_id%3=1 then 'polygon' else 'none' end as mode",
    "case when image_id%7=0 then 'tree' when image_id%2=0 then 'stacked' else 'cutout' end as hierarchical",
    "case when image_id%5=0 then 'crisp' when image_id%5=1 then 'balanced' when image_id%5=2 then 'smooth' else 'none' end as smoothness",
    "cast(width%90-10 as int) as filter_speckle",
    "cast(width%12-1 as int) as color_precision",
    "cast(height%300-20 as int) as layer_difference",
    "cast(height%220-20 as int) as corner_threshold",
    "cast(width%140 as double)/10 as length_threshold",
    "cast(width%200-9 as int) as splice_threshold",
    "cast(height%15-2 as int) as path_precision",
    "cast(width%50-3 as int) as max_iterations",
]

SPARK_LANG = [
    "image_id",
    "case when image_id%6=0 then 'eng' when image_id%6=1 then 'eng+fra' when image_id%6=2 then 'en' when image_id%6=3 then 'ENG' when image_id%6=4 then 'eng+' else concat('deu', cast(chr(10) as string)) end as lang",
]
DUCK_LANG = ", ".join(SPARK_LANG).replace("string", "varchar")

SPARK_COLOR = [
    "image_id",
    "case when image_id%6=0 then concat('#', substr(md5(cast(image_id as string)),1,6)) when image_id%6=1 then concat('#', substr(md5(cast(image_id as string)),1,3)) when image_id%6=2 then substr(md5(cast(image_id as string)),1,6) when image_id%6=3 then concat('#', substr(md5(cast(image_id as string)),1,2), 'zzzz') when image_id%6=4 then '#xyz' else concat('#', substr(md5(cast(image_id as string)),1,8)) end as color",
]
DUCK_COLOR = ", ".join(SPARK_COLOR).replace("string", "varchar")

SPARK_RECIPE = [
    "image_id as recipe_id",
    "element_at(array('adjust','compress','scale','remove-background','margin','merge','ocr'), cast(image_id%7+1 as int)) as tool_id",
    "map('brightness', cast(width%230 as string), 'blur', cast(height%25 as string), 'maxSize', cast(width as string), 'quality', cast(height%110 as string), 'percent', cast(width%220 as string), 'fitWidth', cast(width%40 as string), 'tolerance', cast(height%115 as string), 'opacity', cast(width%130-10 as string), 'all', cast(height%50-5 as string), 'files', cast(width%4 as string), 'lang', if(width%2=0,'eng','')) as params",
]

DUCK_RECIPE = """r as (select image_id as recipe_id,
  ['adjust','compress','scale','remove-background','margin','merge','ocr'][cast(image_id%7+1 as int)] as tool_id,
  width, height from images),
bad as (select recipe_id, tool_id, list_sort(list_filter([
  case when tool_id='adjust' and width%230>200 then 'brightness' end,
  case when tool_id='adjust' and height%25>20 then 'blur' end,
  case when tool_id='compress' and width<320 then 'maxSize' end,
  case when tool_id='compress' and (height%110<10 or height%110>95) then 'quality' end,
  case when tool_id='scale' and (width%220<1 or width%220>200) then 'percent' end,
  case when tool_id='scale' and width%40<16 then 'fitWidth' end,
  case when tool_id='remove-background' and (height%115<1 or height%115>100) then 'tolerance' end,
  case when tool_id='margin' and (width%130-10<0 or width%130-10>100) then 'opacity' end,
  case when tool_id='margin' and height%50-5<0 then 'all' end,
  case when tool_id='merge' and width%4<2 then 'files' end,
  case when tool_id='ocr' and width%2<>0 then 'lang' end], lambda z: z is not null)) as failed from r)"""


def _batches(s, d):
    return X.images(s, d).selectExpr("image_id", "album", "pos", "file_name", "cast(image_id%3 as int) as batch")


DUCK_BATCHES = IMG + ", b as (select image_id, album, pos, file_name, cast(image_id%3 as int) as batch from images)\n"
REASON = """case when mime not in ('image/png','image/jpeg','image/jpg','image/webp') then 'unsupported_type'
  when size_bytes=0 then 'empty' when size_bytes>10*1024*1024 then 'too_large' end"""
SIZE_LABEL = """case when {0}<1024 then concat(cast({0} as varchar),' B')
  when {0}<1048576 then concat(cast((({0}*20+1024)//2048)//10 as varchar),'.',cast((({0}*20+1024)//2048)%10 as varchar),' KB')
  else concat(cast((({0}*200+1048576)//2097152)//100 as varchar),'.',lpad(cast((({0}*200+1048576)//2097152)%100 as varchar),2,'0'),' MB') end"""
HALF = "cast(floor({}+0.5) as bigint)"


def _half(e):
    return HALF.format(e)


def _one(e):
    return f"greatest(1, {_half(e)})"


CROP = f"""t as (select *, height as tw, width as th from images),
u as (select *, greatest(0, least({_half('0.13::double*tw')}, tw-1)) as crop_x, greatest(0, least({_half('0.27::double*th')}, th-1)) as crop_y from t)"""

QUERIES = {
    "intake_guard": (
        lambda s, d: I.intake_guard(X.images(s, d)).select("image_id", "reason", "status"),
        IMG + f"""select image_id, {REASON} as reason, case when ({REASON})='too_large' then 413
          when ({REASON}) is not null then 400 end as status from images""",
    ),
    "upscale_guard": (
        lambda s, d: I.upscale_guard(X.images(s, d)).select("image_id", "width", "height", "too_big"),
        IMG + "select image_id, width, height, greatest(width,height)>1500 as too_big from images",
    ),
    "append_cap": (
        lambda s, d: I.append_cap(_batches(s, d), 5).select("album", "image_id", "list_pos"),
        DUCK_BATCHES + """select album, image_id, list_pos from (select *, cast(row_number() over
          (partition by album order by batch, pos) as int) as list_pos from b) where list_pos<=5""",
    ),
    # The route of large caps, forced.
    "append_cap_numbered": (
        lambda s, d: I.append_cap(_batches(s, d), 5, numbered_above=4).select("album", "image_id", "list_pos"),
        DUCK_BATCHES + """select album, image_id, list_pos from (select *, row_number() over
          (partition by album order by batch, pos) as list_pos from b) where list_pos<=5""",
    ),
    "append_cap_single": (
        lambda s, d: I.append_cap(_batches(s, d), 1).select("album", "image_id"),
        DUCK_BATCHES + """select album, image_id from (select *, row_number() over
          (partition by album order by batch desc, pos) as rn from b) where rn=1""",
    ),
    "append_uncapped": (
        lambda s, d: I.append_cap(_batches(s, d), None).select("album", "image_id", "list_pos"),
        DUCK_BATCHES + """select album, image_id, row_number() over
          (partition by album order by batch, pos) as list_pos from b""",
    ),
    "output_format": (
        lambda s, d: C.output_format(X.images(s, d)).select("image_id", "out_mime"),
        IMG + """select image_id, case when mime in ('image/jpeg','image/png','image/webp') then mime
          else 'image/png' end as out_mime from images""",
    ),
    "format_extension": (
        lambda s, d: C.format_extension(
            X.images(s, d).selectExpr("image_id", "if(image_id%10=7,'image/avif',if(image_id%10=3,'image/x-icon',mime)) as mime")
        ),
        IMG + """select image_id, mime, case mime when 'image/jpeg' then 'jpg' when 'image/png' then 'png' when 'image/webp' then 'webp'
          when 'image/avif' then 'avif' when 'image/x-icon' then 'ico' end as extension from (select image_id,
          if(image_id%10=7,'image/avif',if(image_id%10=3,'image/x-icon',mime)) as mime from images)""",
    ),
    "rename_output": (
        lambda s, d: C.rename_output(X.images(s, d), "scaled").select("image_id", "out_name"),
        IMG + """select image_id, concat(regexp_replace(file_name, '\\.[^/.]+$', ''), '-scaled.', case mime when 'image/jpeg' then 'jpg'
          when 'image/webp' then 'webp' else 'png' end) as out_name from images""",
    ),
    "dedupe_names": (
        lambda s, d: C.dedupe_names(X.images(s, d)).select("album", "image_id", "unique_name"),
        IMG + """, k as (select *, row_number() over (partition by album, file_name order by pos) as k,
          case when contains(file_name,'.') then length(file_name)-position('.' in reverse(file_name)) else length(file_name) end as n from images)
          select album, image_id, case when k=1 then file_name else concat(substr(file_name,1,n), '-', cast(k as varchar), substr(file_name,n+1)) end as unique_name from k""",
    ),
    "format_bytes": (
        lambda s, d: C.format_bytes(X.images(s, d).selectExpr("image_id", "size_bytes div (image_id%1000+1) as size_bytes")),
        IMG + """, z as (select image_id, size_bytes // (image_id%1000+1) as size_bytes from images)
          select image_id, size_bytes, """ + SIZE_LABEL.format("size_bytes") + " as size_label from z",
    ),
    "clamp_quality": (
        lambda s, d: C.clamp_quality(X.images(s, d).selectExpr("image_id", "cast(width%140 as int) as quality")),
        IMG + "select image_id, cast(width%140 as int) as quality, least(1.0::double, greatest(0.1::double, (width%140)/100.0::double)) as encoder_quality from images",
    ),
    "fit_max_side": (
        lambda s, d: C.fit_max_side(X.images(s, d), 1000).select("image_id", "out_width", "out_height"),
        IMG + f"""select image_id, case when width<=1000 and height<=1000 then width else {_half('width*(1000::double/greatest(width,height))')} end as out_width,
          case when width<=1000 and height<=1000 then height else {_half('height*(1000::double/greatest(width,height))')} end as out_height from images""",
    ),
    "scale_dims": (
        lambda s, d: C.scale_dims(X.images(s, d), percent=33).select(
            "image_id", F.lit("percent").alias("mode"), "out_width", "out_height"
        ).unionByName(
            C.scale_dims(X.images(s, d), fit_width=800, fit_height=600).select(
                "image_id", F.lit("fit").alias("mode"), "out_width", "out_height")
        ),
        IMG + f"""select image_id, 'percent' as mode, {_one('width*(33/100.0::double)')} as out_width, {_one('height*(33/100.0::double)')} as out_height from images
          union all select image_id, 'fit', {_one('width*least(800::double/width, 600::double/height, 1.0::double)')},
          {_one('height*least(800::double/width, 600::double/height, 1.0::double)')} from images""",
    ),
    "upscale_dims": (
        lambda s, d: C.upscale_dims(X.images(s, d)).select("image_id", "out_width", "out_height"),
        IMG + "select image_id, width*4 as out_width, height*4 as out_height from images",
    ),
    "preview_dims": (
        lambda s, d: C.preview_dims(X.images(s, d)).select("image_id", "out_width", "out_height"),
        IMG + f"""select image_id, {_one('width*least(1.0::double, 480::double/greatest(width,height))')} as out_width,
          {_one('height*least(1.0::double, 480::double/greatest(width,height))')} as out_height from images""",
    ),
    "crop_geometry": (
        lambda s, d: C.crop_geometry(X.images(s, d), 90, 0.13, 0.27, 0.5, 0.9).select(
            "image_id", "crop_x", "crop_y", "crop_width", "crop_height"),
        IMG + "," + CROP + f"""select image_id, crop_x, crop_y, greatest(1, least({_half('0.5::double*tw')}, tw-crop_x)) as crop_width,
          greatest(1, least({_half('0.9::double*th')}, th-crop_y)) as crop_height from u""",
    ),
    "aspect_crop": (
        lambda s, d: C.aspect_crop(X.images(s, d)).selectExpr(
            "image_id", "preset", "round(k,9) as k", "round(crop_x,9) as crop_x", "round(crop_y,9) as crop_y",
            "round(crop_width,9) as crop_width", "round(crop_height,9) as crop_height"),
        IMG + """, p as (select i.image_id, q.preset, (width::double/height)*(coalesce(q.rh,height)::double/coalesce(q.rw,width)) as k
            from images i, (values ('1:1',1,1),('4:3',4,3),('16:9',16,9),('original',null,null)) q(preset,rw,rh)),
          c as (select *, case when k<=1 then 1.0::double else 1/k end as w, case when k<=1 then k else 1.0::double end as h from p)
          select image_id, preset, round(k,9) as k, round((1-w)/2,9) as crop_x, round((1-h)/2,9) as crop_y, round(w,9) as crop_width, round(h,9) as crop_height from c""",
    ),
    "icon_letterbox": (
        lambda s, d: C.icon_letterbox(X.images(s, d), 300).select(
            "image_id", "side", "draw_x", "draw_y", "draw_width", "draw_height"),
        IMG + f""", q as (select image_id, 256::bigint as side, {_one('width*least(256::double/width,256::double/height)')} as draw_width,
            {_one('height*least(256::double/width,256::double/height)')} as draw_height from images)
          select image_id, side, {_half('(side-draw_width)/2.0::double')} as draw_x, {_half('(side-draw_height)/2.0::double')} as draw_y, draw_width, draw_height from q""",
    ),
    "margin_geometry": (
        lambda s, d: C.margin_geometry(X.images(s, d), "percent", 80, top=5, right=7.5, bottom=-3, left=0.01).select(
            "image_id", "margin_top", "margin_right", "margin_bottom", "margin_left", "out_width", "out_height", "out_mime"),
        IMG + f""", q as (select image_id, width, height, {_half('least(width,height)*5.0::double/100')} as margin_top,
            {_half('least(width,height)*7.5::double/100')} as margin_right, 0::bigint as margin_bottom, {_half('least(width,height)*0.01::double/100')} as margin_left from images)
          select image_id, margin_top, margin_right, margin_bottom, margin_left, width+margin_left+margin_right as out_width,
            height+margin_top+margin_bottom as out_height, 'image/png' as out_mime from q""",
    ),
    "parse_hex_color": (
        lambda s, d: C.parse_hex_color(X.images(s, d).selectExpr(*SPARK_COLOR)),
        IMG + f""", c as (select {DUCK_COLOR} from images), q as (select *, replace(color,'#','') as bare from c),
          e as (select *, case when length(bare)=3 then concat(bare[1],bare[1],bare[2],bare[2],bare[3],bare[3]) else bare end as full_hex from q),
          v as (select *, regexp_extract(full_hex,'^[0-9a-f]+') as hex from e),
          n as (select *, list_reduce(list_prepend(0::bigint, list_transform(string_split(right(hex,8),''), lambda ch: cast(position(ch in '0123456789abcdef')-1 as bigint))), lambda acc, z: acc*16+z) as num from v)
          select image_id, color, case when hex='' then 255 else cast((num>>16)&255 as int) end as red, case when hex='' then 255 else cast((num>>8)&255 as int) end as green,
            case when hex='' then 255 else cast(num&255 as int) end as blue from n""",
    ),
    "validate_recipes": (
        lambda s, d: C.validate_recipes(X.images(s, d).selectExpr(*SPARK_RECIPE)).select(
            "recipe_id", "tool_id", F.array_join("failed", ",").alias("failed"), "valid"),
        IMG + "," + DUCK_RECIPE + " select recipe_id, tool_id, array_to_string(failed, ',') as failed, len(failed)=0 as valid from bad",
    ),
    "trace_params_manual": (
        lambda s, d: C.trace_params_manual(X.images(s, d).selectExpr(*TRACE_REQUEST)),
        IMG + f""", q as (select {", ".join(TRACE_REQUEST)} from images)
          select image_id, preset, mode, hierarchical, smoothness, greatest(0,least(64,filter_speckle)) as filter_speckle,
            greatest(1,least(8,color_precision)) as color_precision, greatest(0,least(256,layer_difference)) as layer_difference,
            greatest(0,least(180,case smoothness when 'crisp' then 30 when 'balanced' then 60 when 'smooth' then 100 else corner_threshold end)) as corner_threshold,
            greatest(3.5::double,least(10.0::double,case smoothness when 'crisp' then 4.0::double when 'balanced' then 4.0::double when 'smooth' then 6.0::double else length_threshold end)) as length_threshold,
            greatest(0,least(180,splice_threshold)) as splice_threshold, greatest(1,least(10,path_precision)) as path_precision,
            greatest(1,least(40,max_iterations)) as max_iterations,
            case when preset not in ('auto','manual') then 'preset' when mode not in ('spline','polygon','none') then 'mode'
                 when hierarchical not in ('stacked','cutout') then 'hierarchical' end as error from q""",
    ),
    "trace_params_auto": (
        lambda s, d: C.trace_params_auto(
            X.images(s, d).selectExpr("image_id", "cast(width%700+1 as int) as width", "cast(height%700+1 as int) as height", "image_id%3=0 as flat")),
        IMG + """, q as (select image_id, cast(width%700+1 as int) as width, cast(height%700+1 as int) as height, image_id%3=0 as flat from images),
          f as (select *, case when flat and greatest(width,height)<600 then cast(greatest(1,least(4,round_even(1000.0::double/greatest(width,height),0))) as int) else 1 end as factor from q)
          select image_id, width, height, flat, factor, case when flat then least(64, 8*factor) else 10 end as filter_speckle, 6 as color_precision,
            case when flat then 16 else 28 end as layer_difference, 60 as corner_threshold, 4.0::double as length_threshold, 45 as splice_threshold,
            case when factor>1 then 2 else 3 end as path_precision, 10 as max_iterations from f""",
    ),
    "ocr_lang_check": (
        lambda s, d: C.ocr_lang_check(X.images(s, d).selectExpr(*SPARK_LANG)),
        IMG + f", q as (select {DUCK_LANG} from images) select image_id, lang, regexp_matches(lang, '^[a-z]{{3}}(\\+[a-z]{{3}})*\\n?$') as lang_ok from q",
    ),
}
