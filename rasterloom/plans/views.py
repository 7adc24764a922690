"""DuckDB texts of the fixture tables, used as CTEs by the check queries."""

IMAGES = """images as (
select doc_id as image_id, source as album, cast(doc_id as int) as pos,
  concat(case when doc_id%11=0 then 'scan' else concat('img', cast(doc_id%300 as varchar)) end,
         case when doc_id%13=0 then '' when doc_id%4=0 then '.jpg' when doc_id%4=1 then '.png'
              when doc_id%4=2 then '.webp' else '.gif' end) as file_name,
  case when doc_id%4=0 then 'image/jpeg' when doc_id%4=1 then 'image/png'
       when doc_id%4=2 then 'image/webp' else 'image/gif' end as mime,
  cast(16+(doc_id*373)%4001 as int) as width, cast(16+(doc_id*911)%3001 as int) as height,
  cast(case when doc_id%17=0 then 0 else n_chars*1024 end as bigint) as size_bytes
from documents)"""

PIXELS = """pixels as (
select cast(floor(vec_id/16) as bigint) as image_id, cast((vec_id%16)*2+floor(p/32) as int) as y, cast(p%32 as int) as x,
  cast(case when floor(vec_id/16)%3=0 then floor(r0/128)*128 else r0 end as int) as r,
  cast(case when floor(vec_id/16)%3=0 then floor(g0/128)*128 else g0 end as int) as g,
  cast(case when floor(vec_id/16)%3=0 then 0 else (vec_id*37+p*11)%256 end as int) as b,
  cast(case when floor(vec_id/16)%2=0 then 255 else 255-(p%5)*20 end as int) as a
from (select vec_id, p,
        floor((least(greatest(cast(v  as double)*3,-1.0::double),1.0::double)+1)*127.5::double) as r0,
        floor((least(greatest(cast(v2 as double)*3,-1.0::double),1.0::double)+1)*127.5::double) as g0
      from (select vec_id, p, embedding[p+1] as v, embedding[len(embedding)-p] as v2
            from (select vec_id, embedding, unnest(range(len(embedding))) as p from embeddings))))"""

# One image: eight vectors make a line of 512 pixels, in 16 levels so that neighbours share colours.
WIDE = """pixels as (
select 0::bigint as image_id, cast(vec_id//8 as int) as y, cast((vec_id%8)*64+p as int) as x, cast(floor(r0/32)*32 as int) as r, cast(floor(r0/128)*128 as int) as g, 0 as b,
  cast(case when vec_id%3=0 then 255 else 128 end as int) as a
from (select vec_id, p, floor((least(greatest(cast(v as double)*3,-1.0::double),1.0::double)+1)*127.5::double) as r0
      from (select vec_id, p, embedding[p+1] as v from (select vec_id, embedding, unnest(range(len(embedding))) as p from embeddings))))"""

SIZED = """dims as (select image_id, cast(max(x)+1 as int) as width, cast(max(y)+1 as int) as height from pixels group by 1),
sized as (select p.*, d.width, d.height from pixels p join dims d using (image_id))"""

RUNGS = """rungs as (
select doc_id as image_id, cast(k as int) as k,
  cast(floor(n_chars*1024*(k+1)/128) + case when doc_id%5=0 then ((k*37)%11)*n_chars else 0 end as bigint) as size_bytes
from (select doc_id, n_chars, unnest(range(128)) as k from documents))"""

DETECTIONS = r"""dw as (
  select doc_id, i, ws[i+1] as w, length(ws[i+1]) as n from (
    select doc_id, ws, unnest(range(len(ws))) as i from (
      select doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda z: z<>'') as ws from documents))),
detections as (
select doc_id as image_id, 0 as pass, cast(i as int) as seq, cast(case when i%23=22 then 4 else 5 end as int) as level,
  case when i%29=28 then '  ' else concat(w, ' ') end as text,
  case when i%31=30 then 'n/a' else cast((doc_id*31+i*17)%101 as varchar) end as conf,
  cast((i%10)*90 as int) as left_px, cast(floor(i/10)*22+(i*7)%4 as int) as top_px, cast(8*n as int) as width_px, 16 as height_px
from dw
union all
select doc_id, 1, cast(i as int), 5, w, cast(((doc_id*31+i*17)%101*7+13)%101 as varchar),
  cast((i%10)*90+(i%5)*4 as int), cast(floor(i/10)*22+(i*7)%4+i%3 as int), cast(8*n as int), 16
from dw where i%3<>1)"""

OCR_SIZES = """ocr_sizes as (select doc_id as image_id, cast(if(doc_id%19=0, 0, 900) as int) as width,
  cast(if(doc_id%19=0, 0, 160+n_chars*4) as int) as height from documents)"""

TOOLS = """tools as (select * from (values
  ('resize', 1, false, 'edited', null), ('scale', null, true, 'scaled', null),
  ('convert', null, true, 'converted', null), ('convert-svg', null, true, 'vector', 'svg'),
  ('compress', null, true, 'compressed', null), ('strip-metadata', null, true, 'clean', null),
  ('remove-background', null, true, 'transparent', 'png'), ('adjust', null, true, 'adjusted', null),
  ('margin', null, true, 'margin', null), ('merge', null, true, 'merged', 'png'),
  ('upscale', null, true, 'upscaled', 'png'), ('ocr', null, true, '', 'txt')
  ) t(tool_id, max_files, batch, suffix, out_ext)),
accepts as (select tool_id, mime from tools, (values ('image/jpeg'), ('image/png'), ('image/webp')) m(mime))"""


def cte(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


def recursive(*views: str) -> str:
    return "with recursive " + ",\n".join(views) + "\n"
