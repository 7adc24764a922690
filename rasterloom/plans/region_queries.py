"""Registered queries on colours, palettes, regions and SVG."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rasterloom.operators import pixels_point as P
from rasterloom.operators import regions as R
from rasterloom.plans import views as V
from rasterloom.plans.pixel_queries import MEDIAN, MODE, PX, SZ, _lanczos_sql
from rasterloom.sources import fixtures as X

FLAT = """h as (select image_id, r, g, b, count(*) as n from pixels group by all),
  hr as (select *, row_number() over (partition by image_id order by n desc) as rn from h),
  flat as (select image_id, count(*) as n_colors, count(*)<=4096 and sum(case when rn<=12 then n else 0 end)/sum(n)::double>=0.85 as flat from hr group by 1)"""
FLAGS = FLAT + """, fl as (select d.*, n_colors, flat, min_alpha, max_alpha, min_alpha<255 as has_alpha from dims d join flat using (image_id)
    join (select image_id, min(a) as min_alpha, max(a) as max_alpha from pixels group by 1) using (image_id)),
  flags as (select *, case when flat and greatest(width,height)<600 then cast(greatest(1,least(4,round_even(1000.0::double/greatest(width,height),0))) as int) else 1 end as factor from fl)"""


def _cut_sql():
    parts = ["h0 as (select image_id, r, g, b, count(*) as n, 0 as box from pixels group by image_id, r, g, b)"]
    for i in range(1, 5):
        parts.append(f"""s{i} as (select *, max(r) over w-min(r) over w as sr, max(g) over w-min(g) over w as sg, max(b) over w-min(b) over w as sb,
            sum(n) over w as total, count(*) over w as colors from h{i - 1} window w as (partition by image_id, box)),
          a{i} as (select *, case when sr>=sg and sr>=sb then r when sg>=sb then g else b end as along from s{i}),
          o{i} as (select *, coalesce(sum(n) over (partition by image_id, box order by along, r, g, b rows between unbounded preceding and 1 preceding),0) as before,
            row_number() over (partition by image_id, box order by along, r, g, b) as nth from a{i}),
          h{i} as (select image_id, r, g, b, n, box*2+case when colors>1 and (before*2>=total or nth=colors) then 1 else 0 end as box from o{i})""")
    return ",\n".join(parts)


PALETTE = _cut_sql() + """, pal as (select image_id, box, cast(sum(n) as bigint) as weight, """ + ", ".join(
    f"cast(round_even(sum({c}*n)/sum(n)::double,0) as int) as p{c}" for c in "rgb") + " from h4 group by 1,2)"

RUNS = """cl as (select *, (a::bigint<<24)|(r::bigint<<16)|(g::bigint<<8)|b::bigint as color from pixels),
  st as (select *, case when lag(color) over (partition by image_id, y order by x) is distinct from color then x end as s0 from cl),
  rx as (select *, max(s0) over (partition by image_id, y order by x) as x0 from st),
  runs as (select image_id, y, x0, max(x) as x1, any_value(color) as color, any_value(r) as r, any_value(g) as g, any_value(b) as b, any_value(a) as a from rx group by image_id, y, x0)"""
REGIONS = RUNS + """, nodes as (select *, (y::bigint<<32)+x0 as node from runs),
  e1 as (select p.image_id, p.node as u, q.node as v from nodes p join nodes q on p.image_id=q.image_id and p.y+1=q.y and p.color=q.color and p.x0<=q.x1 and q.x0<=p.x1),
  e as (select * from e1 union all select image_id, v, u from e1),
  reach(image_id, node, label) as (select image_id, node, node from nodes
    union select e.image_id, e.v, l.label from reach l join e on e.image_id=l.image_id and e.u=l.node where l.label<e.v),
  lab as (select image_id, node, min(label) as label from reach group by 1,2)"""

SPECKLE = REGIONS + """, lp as (select p.image_id, p.y, p.x, p.color, l.label from rx p join lab l on l.image_id=p.image_id and l.node=(p.y::bigint<<32)+p.x0),
  sm as (select image_id, label from lp group by 1,2 having count(*)<3),
  nbr as (select a.image_id, a.label, b.label as other, b.color from lp a join (values (0,1),(0,-1),(1,0),(-1,0)) m(dy,dx) on true
    join lp b on b.image_id=a.image_id and b.y=a.y+dy and b.x=a.x+dx where a.label<>b.label),
  bd as (select image_id, label, other, any_value(color) as color, count(*) as len from nbr semi join sm using (image_id, label) group by 1,2,3),
  ch as (select *, row_number() over (partition by image_id, label order by len desc, other) as rn from bd),
  nw as (select lp.image_id, lp.y, lp.x, coalesce(ch.color, lp.color) as c from lp left join ch on ch.image_id=lp.image_id and ch.label=lp.label and ch.rn=1)"""


def _px(s, d):
    return X.pixels(s, d)


def _sized(s, d):
    return P.with_dims(X.pixels(s, d))


SVG = """body as (select image_id, y+1 as ord, string_agg(concat('<rect x="',x0,'" y="',y,'" width="',x1-x0+1,'" height="1" fill="#',
    printf('%02x',r),printf('%02x',g),printf('%02x',b),case when a<255 then printf('%02x',a) else '' end,'"/>'), '' order by x0) as line from runs where a>0 group by 1,2),
  alll as (select * from body union all select image_id, 0, concat('<svg xmlns="http://www.w3.org/2000/svg" width="',width*2,'" height="',height*2,'" viewBox="0 0 ',width,' ',height,'">') from dims
    union all select image_id, height+1, '</svg>' from dims)"""


def _sizes(s, d):
    return P.image_dims(_px(s, d)).withColumns({"orig_width": F.col("width") * 2, "orig_height": F.col("height") * 2})


def _renamed(sql: str, *names: str) -> str:
    """The text with its own intermediate names set apart."""
    for name in names:
        sql = re.sub(rf"\b{name}\b", f"{name}_photo", sql)
    return sql


# All flat images of the fixture have the factor 4.
TRACE = f"""drawn as (select s.* from sized s join flags using (image_id) where flat and factor=4),
{_lanczos_sql(4).replace("from sized", "from drawn")},
opaque as (select l.* from lanczos l join flags using (image_id) where not has_alpha), {MODE.replace("from pixels c", "from opaque c")},
major as (select p.image_id, p.y, p.x, coalesce(mr,r) as r, coalesce(mg,g) as g, coalesce(mb,b) as b, a, p.width, p.height from opaque p join wide using (image_id, y, x)),
{PALETTE.replace("from pixels group by", "from major group by")},
photos as (select s.* from sized s join flags using (image_id) where not flat), {_renamed(MEDIAN, "c", "o", "nb").replace("from sized p", "from photos p")}
select t.*, d.width as orig_width, d.height as orig_height from (
  select p.image_id, p.y, p.x, pr as r, pg as g, pb as b, a, width, height from major p join h4 using (image_id, r, g, b) join pal using (image_id, box)
  union all by name select l.* from lanczos l join flags using (image_id) where has_alpha
  union all by name select m.*, d.width, d.height from (select image_id, y, x, {", ".join(f"list_sort(list({c}))[5] as {c}" for c in "rgb")}, 255 as a from nb_photo group by 1, 2, 3) m
    join dims d using (image_id)) t join dims d using (image_id)"""

REGION_SQL = V.recursive(V.PIXELS) + "," + REGIONS + """ select image_id, cast(label>>32 as int) as first_y, cast(label&4294967295 as int) as first_x, cast(sum(x1-x0+1) as bigint) as area,
    min(x0) as "left", min(y) as top, max(x1) as "right", max(y) as bottom, any_value(r) as r, any_value(g) as g, any_value(b) as b, any_value(a) as a
    from nodes join lab using (image_id, node) group by image_id, label"""
SPECKLE_SQL = V.recursive(V.PIXELS) + "," + SPECKLE + " select image_id, y, x, cast((c>>16)&255 as int) as r, cast((c>>8)&255 as int) as g, cast(c&255 as int) as b, cast((c>>24)&255 as int) as a from nw"


def WIDE(sql: str) -> str:
    """The same text over one image that holds all vectors."""
    return sql.replace(V.PIXELS, V.WIDE)


QUERIES = {
    "flat_art_flag": (lambda s, d: R.flat_art_flag(_sized(s, d)), PX + "," + FLAT + " select image_id, n_colors, flat from flat"),
    "trace_flags": (
        lambda s, d: R.trace_flags(_sized(s, d)).select("image_id", "width", "height", "n_colors", "flat", "has_alpha", "factor", "filter_speckle", "layer_difference", "path_precision"),
        SZ + "," + FLAGS + """ select image_id, width, height, n_colors, flat, has_alpha, factor, case when flat then least(64,8*factor) else 10 end as filter_speckle,
          case when flat then 16 else 28 end as layer_difference, case when factor>1 then 2 else 3 end as path_precision from flags"""),
    "median_cut": (
        lambda s, d: R.palette(R.median_cut(P.color_histogram(_px(s, d)))), PX + "," + PALETTE + " select * from pal"),
    "median_cut_marginals": (
        lambda s, d: R.palette(R.median_cut(P.color_histogram(_px(s, d)), window_colors=100)), PX + "," + PALETTE + " select * from pal"),
    # One image of all pixels.
    "median_cut_wide": (
        lambda s, d: R.palette(R.median_cut(P.color_histogram(X.wide(s, d)), window_colors=1)), WIDE(PX) + "," + PALETTE + " select * from pal"),
    "quantize": (
        lambda s, d: R.quantize(_px(s, d)),
        PX + "," + PALETTE + " select p.image_id, p.y, p.x, pr as r, pg as g, pb as b, a from pixels p join h4 using (image_id, r, g, b) join pal using (image_id, box)"),
    "trace_prepare": (lambda s, d: R.trace_prepare(_sized(s, d)), SZ + "," + FLAGS + "," + TRACE),
    "color_runs": (lambda s, d: R.color_runs(_px(s, d)), PX + "," + RUNS + " select image_id, y, x0, x1, r, g, b, a from runs"),
    "color_regions": (lambda s, d: R.color_regions(_px(s, d)), REGION_SQL),
    "speckle_filter": (lambda s, d: R.speckle_filter(_px(s, d), 3), SPECKLE_SQL),
    # Tiles of eight: regions that cross many seams, forced on small images.
    "color_regions_tiles": (lambda s, d: R.color_regions(_px(s, d), 8), REGION_SQL),
    "speckle_filter_tiles": (lambda s, d: R.speckle_filter(_px(s, d), 3, 8), SPECKLE_SQL),
    # One image of all vectors, wider than a tile.
    "color_regions_wide": (lambda s, d: R.color_regions(X.wide(s, d)), WIDE(REGION_SQL)),
    "svg_lines": (
        lambda s, d: R.svg_lines(R.color_runs(_px(s, d)), _sizes(s, d)), SZ + "," + RUNS + "," + SVG + " select * from alll"),
    "svg_rects": (
        lambda s, d: R.svg_rects(R.color_runs(_px(s, d)), _sizes(s, d)),
        SZ + "," + RUNS + "," + SVG + " select image_id, string_agg(line, chr(10) order by ord) as svg from alll group by 1"),
}
