"""Registered queries on the pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import exif as E
from rasterloom.operators import pixels_geometry as G
from rasterloom.operators import pixels_neighborhood as N
from rasterloom.operators import pixels_point as P
from rasterloom.operators import planning as L
from rasterloom.operators import tiles as TI
from rasterloom.plans import views as V
from rasterloom.sources import fixtures as X

PX = V.cte(V.PIXELS)
SZ = V.cte(V.PIXELS, V.SIZED)
BASE = "image_id, y, x"
U8 = "cast(greatest(0,least(255,floor({}+0.5))) as int)"


def _px(s, d):
    return X.pixels(s, d)


def _sized(s, d):
    return P.with_dims(X.pixels(s, d))


def _u8(e):
    return U8.format(e)


def _mix(src, matrix):
    cols = ", ".join(
        _u8(" + ".join(f"{ch}*{w!r}::double" for ch, w in zip("rgb", row))) + f" as {c}" for c, row in zip("rgb", matrix))
    return f"select {BASE}, {cols}, a from {src}"


def _sepia_sql(src, p):
    return _mix(src, P.sepia_matrix(p))


def _bright(src, p):
    return f"select {BASE}, " + ", ".join(_u8(f"{c}*{p / 100!r}::double") + f" as {c}" for c in "rgb") + f", a from {src}"


def _contrast(src, p):
    return f"select {BASE}, " + ", ".join(_u8(f"({c}-127.5::double)*{p / 100!r}::double+127.5::double") + f" as {c}" for c in "rgb") + f", a from {src}"


def _sharpen_sql(src, k):
    """CTE list ending in ``sharp``: the 3x3 cross over ``src``."""
    near = ", ".join(
        f"coalesce({fn}({c}) over {w}, {c}) as {c}{n}"
        for c in "rgb" for n, fn, w in (("u", "lag", "co"), ("d", "lead", "co"), ("l", "lag", "ro"), ("r", "lead", "ro")))
    out = ", ".join(
        f"cast(round_even(greatest(0,least(255,{c}*{1 + 4 * k!r}::double-{float(k)!r}::double*({c}u+{c}d+{c}l+{c}r))),0) as int) as {c}" for c in "rgb")
    return f"""near as (select *, {near} from {src} window ro as (partition by image_id, y order by x), co as (partition by image_id, x order by y)),
      sharp as (select {BASE}, {out}, a from near)"""


def _blur_sql(src, sigma):
    w = N.blur_weights(sigma)
    reach = len(w) - 1
    table = "bw as (select * from (values " + ", ".join(f"({d},{w[abs(d)]})" for d in range(-reach, reach + 1)) + ") t(d, w))"

    def once(name, source, axis):
        other = "y" if axis == "x" else "x"
        return f"""{name}_s as (select p.image_id, p.{other}, p.{axis}+bw.d as {axis}, sum(w) as n, sum(w::bigint*a) as na, sum(w::bigint*a*r) as nr, sum(w::bigint*a*g) as ng, sum(w::bigint*a*b) as nb
            from {source} p, bw group by all),
          {name} as (select s.image_id, s.y, s.x, {', '.join(f"cast(case when na=0 then 0 else (2*n{c}+na)//(2*na) end as int) as {c}" for c in 'rgb')}, cast((2*na+n)//(2*n) as int) as a
            from {name}_s s semi join pixels p on p.image_id=s.image_id and p.y=s.y and p.x=s.x)"""
    return ",\n".join([table, once("b1", src, "x"), once("blurred", "b1", "y")])


def _resample_sql(src, tw, th, keys="image_id"):
    """CTE list ending in ``scaled``; gathers, for every target cell, the source cells below it."""
    def weight(size, t):
        near = f"2*{t}-abs((2*k+1)*{size}-{t}*(2*i+1))"
        over = f"least((i+1)*{t},(k+1)*{size})-greatest(i*{t},k*{size})"
        return f"greatest(0, case when {t}<={size} then {over} else {near} end)"

    def axis(name, size, t):
        return f"""{name} as (select {size}, {t}, i, k, {weight(size, t)} as w from (select *, unnest(range({t})) as k from
          (select *, unnest(range({size})) as i from (select distinct {size}, {t} from src))) where {weight(size, t)}>0)"""
    return f"""src as (select *, cast({tw} as bigint) as tw, cast({th} as bigint) as th from {src}),
      {axis('ax', 'width', 'tw')}, {axis('ay', 'height', 'th')},
      acc as (select {keys}, s.tw, s.th, ay.k as y, ax.k as x, sum(ax.w*ay.w) as n, sum(ax.w*ay.w*a) as na, sum(ax.w*ay.w*a*r) as nr, sum(ax.w*ay.w*a*g) as ng, sum(ax.w*ay.w*a*b) as nb
        from src s join ax on ax.width=s.width and ax.tw=s.tw and ax.i=s.x join ay on ay.height=s.height and ay.th=s.th and ay.i=s.y group by all),
      scaled as (select {keys}, cast(y as int) as y, cast(x as int) as x, {', '.join(f"cast(case when na=0 then 0 else (2*n{c}+na)//(2*na) end as int) as {c}" for c in 'rgb')},
        cast((2*na+n)//(2*n) as int) as a, cast(tw as int) as width, cast(th as int) as height from acc)"""


def _lanczos_sql(f):
    k = f"floor(case when abs(gap)<1e-12 then 1.0::double else 3.0::double*sin(gap*3.141592653589793)*sin(gap*3.141592653589793/3.0::double)/((gap*3.141592653589793)*(gap*3.141592653589793)) end*65536.0::double+0.5)"

    def axis(name, size):
        return f"""{name} as (select {size}, i, k, cast({k} as bigint) as w from (select *, (2*k+1)/{2.0 * f!r}::double-(i+0.5::double) as gap from
          (select *, unnest(range({size}*{f})) as k from (select *, unnest(range({size})) as i from (select distinct {size} from sized)))) where abs(gap)<3)"""
    chans = ("pr", "pg", "pb", "pa")
    sums = ", ".join(f"sum(w*{c}) as s{c}" for c in chans)
    out = ", ".join(f"least(255,(2*greatest(0,s{c})+n)//(2*n)) as {c}" for c in chans)
    return f"""{axis('lx', 'width')}, {axis('ly', 'height')},
      pre as (select image_id, y, x, width, height, (2*r*a+255)//510 as pr, (2*g*a+255)//510 as pg, (2*b*a+255)//510 as pb, a as pa from sized),
      l1 as (select image_id, y, k as x, width, height, {out} from (select image_id, y, k, p.width, height, sum(w) as n, {sums} from pre p join lx on lx.width=p.width and lx.i=p.x group by all)),
      l2 as (select image_id, k as y, x, width, height, {out} from (select image_id, k, x, width, p.height, sum(w) as n, {sums} from l1 p join ly on ly.height=p.height and ly.i=p.y group by all)),
      lanczos as (select image_id, cast(y as int) as y, cast(x as int) as x, {', '.join(f"cast(case when pa=0 then 0 else least(255,p{c}*255//pa) end as int) as {c}" for c in 'rgb')},
        cast(pa as int) as a, cast(width*{f} as int) as width, cast(height*{f} as int) as height from l2)"""


def _thumbnail_sql(source, side):
    """Images that fit as they are, the others scaled."""
    size = lambda n: f"greatest(1,floor({n}*({side}::double/greatest(width,height))+0.5))"
    return (f"large as (select * from {source} where width>{side} or height>{side})," + _resample_sql("large", size("width"), size("height"))
            + f"select {SCOLS} from scaled union all select {SCOLS} from {source} where width<={side} and height<={side}")


def _two_sizes(s, d):
    """Every second image cut to 16 x 12; the others as they are."""
    even = F.col("image_id") % 2 == 0
    cut = _sized(s, d).filter(~even | ((F.col("x") < 16) & (F.col("y") < 12)))
    return cut.withColumns({"width": F.when(even, 16).otherwise(F.col("width")), "height": F.when(even, 12).otherwise(F.col("height"))})


PCOLS = f"{BASE}, r, g, b, a"
SCOLS = PCOLS + ", width, height"
DIST = "sqrt(({r}-{0})*({r}-{0})+({g}-{1})*({g}-{1})+({b}-{2})*({b}-{2}))"


def _key_sql(rgb, tol, smooth):
    lim, band = tol / 100 * 441.672, smooth / 100 * 180.0
    dist = f"sqrt(cast((r-{rgb[0]})*(r-{rgb[0]})+(g-{rgb[1]})*(g-{rgb[1]})+(b-{rgb[2]})*(b-{rgb[2]}) as double))"
    return f"""kd as (select *, {dist} as dist from pixels), keyed as (select {BASE}, r, g, b, case when dist<={lim!r}::double then 0
      when {band!r}::double>0 and dist<={lim + band!r}::double then cast(floor(a*((dist-{lim!r}::double)/{band!r}::double)+0.5) as int) else a end as a from kd)"""


def _oriented(s, d):
    """Orientations come from the files' tags; an image without a tag is upright."""
    tags = E.orientations(E.exif_scan(X.exif_files(s, d)))
    turned = _sized(s, d).join(tags, "image_id", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1)))
    return G.orient_normalize(turned)


def _albums(s, d):
    return P.image_dims(_px(s, d)).selectExpr(
        "image_id", "width", "height", "concat('album', cast(image_id div 4 as string)) as album", "cast(image_id%4 as int) as pos")


def _merged(s, d, direction, align, resize, background):
    sized = _sized(s, d)
    if resize == "fill":  # vary the widths, so that filling has to scale
        sized = G.crop_pixels(sized, 0, 0, F.lit(1.0) - (F.col("image_id") % 3) * F.lit(0.25), 1)
    dims = sized.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    members = dims.selectExpr("image_id", "width", "height", "concat('album', cast(image_id div 4 as string)) as album", "cast(image_id%4 as int) as pos")
    layout = L.merge_layout(members, direction, align, resize)
    return G.merge_images(sized.drop("width", "height").join(dims, "image_id"), layout, direction, background, resize)


MEMBERS = """m as (select image_id, width, height, concat('album', cast(image_id//4 as varchar)) as album, cast(image_id%4 as int) as pos from dims),
  lay as (select *, max(width) over (partition by album) as cw, cast(sum(height) over (partition by album) as bigint) as ch,
    coalesce(sum(height) over (partition by album order by pos rows between unbounded preceding and 1 preceding),0) as py from m),
  lay2 as (select *, cast(floor((cw-width)/2.0::double+0.5) as bigint) as pxo from lay),
  canvas as (select album, any_value(cw) as cw, any_value(ch) as ch from lay2 group by 1),
  cells as (select album, cw, ch, y, unnest(range(cw)) as x from (select *, unnest(range(ch)) as y from canvas)),
  spot as (select l.album, p.y+l.py as y, p.x+l.pxo as x, r, g, b, a from lay2 l join pixels p using (image_id)),
  painted as (select c.album, cast(c.y as int) as y, cast(c.x as int) as x, coalesce(r,0) as r, coalesce(g,0) as g, coalesce(b,0) as b, coalesce(a,0) as a, cast(cw as int) as width, cast(ch as int) as height
    from cells c left join spot s on s.album=c.album and s.y=c.y and s.x=c.x)"""

FILLED = """cropped as (select image_id, y, x, r, g, b, a, cast(floor((1.0::double-(image_id%3)*0.25::double)*width+0.5) as int) as width, height from sized),
  fm as (select distinct image_id, width, height, concat('album', cast(image_id//4 as varchar)) as album, image_id%4 as pos from cropped),
  ft as (select *, max(height) over (partition by album) as ch from fm),
  fd as (select *, cast(greatest(1,floor(width*(ch::double/height)+0.5)) as bigint) as dw, cast(greatest(1,floor(height*(ch::double/height)+0.5)) as bigint) as dh from ft),
  fl as (select image_id, album, dw, dh, ch, cast(sum(dw) over (partition by album) as bigint) as cw,
    cast(coalesce(sum(dw) over (partition by album order by pos rows between unbounded preceding and 1 preceding),0) as bigint) as px from fd),
  placed as (select c.*, fl.album, fl.px, fl.cw, fl.ch, fl.dw, fl.dh from cropped c join fl using (image_id) where c.x<c.width),
  """

MEDIAN = """c as (select p.image_id, p.y, p.x, p.a, d.width, d.height, p.r, p.g, p.b from sized p join dims d using (image_id)),
  o as (select c.*, dy, dx from c, (values (-1),(0),(1)) u(dy), (values (-1),(0),(1)) v(dx)),
  nb as (select o.image_id, o.y, o.x, o.a, q.r, q.g, q.b from o join pixels q on q.image_id=o.image_id
    and q.y=greatest(0,least(o.height-1,o.y+dy)) and q.x=greatest(0,least(o.width-1,o.x+dx)))"""

MODE = """o as (select c.image_id, c.y+dy as y, c.x+dx as x, r, g, b from pixels c, (values (-2),(-1),(0),(1),(2)) u(dy), (values (-2),(-1),(0),(1),(2)) v(dx)),
  nb as (select image_id, y, x, ch, v from o unpivot (v for ch in (r, g, b))),
  ct as (select image_id, y, x, ch, v, count(*) as n from nb group by all),
  best as (select *, row_number() over (partition by image_id, y, x, ch order by n desc, v) as rn from ct),
  wide as (select image_id, y, x, max(case when ch='r' and n>2 then v end) as mr, max(case when ch='g' and n>2 then v end) as mg, max(case when ch='b' and n>2 then v end) as mb from best where rn=1 group by 1,2,3)"""

CHAIN = {"brightness": 110, "contrast": 90, "saturation": 140, "grayscale": 20, "sepia": 30, "invert": True, "blur": 1, "sharpen": 40}

GRID16 = """tg as (select image_id, width, height, cast(ty as int) as ty, cast(tx as int) as tx, {p} as pad from (select *, unnest(range((width-1)//{t}+1)) as tx from
    (select *, unnest(range((height-1)//{t}+1)) as ty from dims))),
  grid as (select image_id, ty, tx, ty*{t} as y0, tx*{t} as x0, least(ty*{t}+{t},height) as y1, least(tx*{t}+{t},width) as x1,
    greatest(ty*{t}-{p},0) as py0, greatest(tx*{t}-{p},0) as px0, least(least(ty*{t}+{t},height)+{p},height) as py1, least(least(tx*{t}+{t},width)+{p},width) as px1 from tg)"""
TG = GRID16.format(t=16, p=4)

QUERIES = {
    "background_share": (
        lambda s, d: P.background_key(_px(s, d), "#ffffff", 40, 20).groupBy("image_id").agg(
            F.count(F.lit(1)).alias("n_pixels"), F.count(F.when(F.col("a") == 0, 1)).alias("n_clear")
        ).withColumn("share", F.round(F.col("n_clear") / F.col("n_pixels"), 6)),
        PX + "," + _key_sql((255, 255, 255), 40, 20) + """select image_id, count(*) as n_pixels, count(*) filter (a=0) as n_clear,
          round(count(*) filter (a=0)/count(*)::double,6) as share from keyed group by 1""",
    ),
    "background_key": (
        lambda s, d: P.background_key(_px(s, d), "#80ff10", 25, 30),
        PX + "," + _key_sql((128, 255, 16), 25, 30) + f"select {PCOLS} from keyed",
    ),
    "adjust_brightness": (lambda s, d: P.adjust_brightness(_px(s, d), 130), PX + _bright("pixels", 130)),
    "adjust_contrast": (lambda s, d: P.adjust_contrast(_px(s, d), 70), PX + _contrast("pixels", 70)),
    "adjust_saturation": (lambda s, d: P.adjust_saturation(_px(s, d), 160), PX + _mix("pixels", P.saturation_matrix(160))),
    "adjust_grayscale": (lambda s, d: P.adjust_grayscale(_px(s, d), 60), PX + _mix("pixels", P.grayscale_matrix(60))),
    "adjust_sepia": (lambda s, d: P.adjust_sepia(_px(s, d), 75), PX + _mix("pixels", P.sepia_matrix(75))),
    "adjust_invert": (
        lambda s, d: P.adjust_invert(_px(s, d)), PX + f"select {BASE}, 255-r as r, 255-g as g, 255-b as b, a from pixels"),
    "adjust_chain": (
        lambda s, d: N.adjust_chain(_px(s, d), CHAIN),
        PX + f""", c1 as ({_bright('pixels', 110)}), c2 as ({_contrast('c1', 90)}), c3 as ({_mix('c2', P.saturation_matrix(140))}),
          c4 as ({_mix('c3', P.grayscale_matrix(20))}), c5 as ({_mix('c4', P.sepia_matrix(30))}),
          c6 as (select {BASE}, 255-r as r, 255-g as g, 255-b as b, a from c5), {_blur_sql('c6', 1)}, {_sharpen_sql('blurred', 0.4)} select * from sharp""",
    ),
    "to_gray": (
        lambda s, d: P.to_gray(_px(s, d)).select("image_id", "y", "x", "gray"),
        PX + f"select {BASE}, cast((r*19595+g*38470+b*7471+32768)//65536 as int) as gray from pixels"),
    "invert_gray": (
        lambda s, d: P.invert_gray(_px(s, d)).select("image_id", "y", "x", "gray"),
        PX + f"select {BASE}, cast(255-(r*19595+g*38470+b*7471+32768)//65536 as int) as gray from pixels"),
    "composite_over": (
        lambda s, d: P.composite_over(_px(s, d), "#204060"),
        PX + f"select {BASE}, " + ", ".join(f"cast((2*({c}*a+{v}*(255-a))+255)//510 as int) as {c}" for c, v in zip("rgb", (32, 64, 96))) + ", 255 as a from pixels"),
    "image_dims": (
        lambda s, d: P.image_dims(_px(s, d)), SZ + "select image_id, width, height from dims"),
    "alpha_extrema": (
        lambda s, d: P.alpha_extrema(_px(s, d)),
        PX + "select image_id, min(a) as min_alpha, max(a) as max_alpha, min(a)<255 as has_alpha from pixels group by 1"),
    "color_histogram": (
        lambda s, d: P.color_histogram(_px(s, d)), PX + "select image_id, r, g, b, count(*) as n from pixels group by all"),
    "rotate_flip": (
        lambda s, d: G.rotate_flip(_sized(s, d), 90, flip_h=True),
        SZ + "select image_id, width-1-x as y, height-1-y as x, r, g, b, a, height as width, width as height from sized"),
    "orient_normalize": (
        _oriented,
        SZ + """, o as (select *, image_id%9 as o from sized) select image_id,
          case when o in (3,4) then height-1-y when o in (5,6) then x when o in (7,8) then width-1-x else y end as y,
          case when o in (2,3) then width-1-x when o in (5,8) then y when o in (6,7) then height-1-y else x end as x, r, g, b, a,
          case when o in (5,6,7,8) then height else width end as width, case when o in (5,6,7,8) then width else height end as height from o"""),
    "crop_pixels": (
        lambda s, d: G.crop_pixels(_sized(s, d), 0.2, 0.1, 0.5, 0.6),
        SZ + """, q as (select *, greatest(0,least(cast(floor(0.2::double*width+0.5) as int),width-1)) as x0, greatest(0,least(cast(floor(0.1::double*height+0.5) as int),height-1)) as y0 from sized),
          q2 as (select *, greatest(1,least(cast(floor(0.5::double*width+0.5) as int),width-x0)) as w, greatest(1,least(cast(floor(0.6::double*height+0.5) as int),height-y0)) as h from q)
          select image_id, y-y0 as y, x-x0 as x, r, g, b, a, w as width, h as height from q2 where x>=x0 and x<x0+w and y>=y0 and y<y0+h"""),
    "resample_shrink": (
        lambda s, d: G.resample(_sized(s, d), 20, 7), SZ + "," + _resample_sql("sized", "20", "7") + f"select {SCOLS} from scaled"),
    "resample_grow": (
        lambda s, d: G.resample(_sized(s, d), 50, 45), SZ + "," + _resample_sql("sized", "50", "45") + f"select {SCOLS} from scaled"),
    "resample_nearest": (
        lambda s, d: G.resample(_sized(s, d), F.col("width") * 2 - 5, 13, method="nearest"),
        SZ + """, t as (select image_id, width as w, height as h, y, x from (select *, unnest(range(width*2-5)) as x from (select *, unnest(range(13)) as y from dims)))
          select t.image_id, cast(t.y as int) as y, cast(t.x as int) as x, r, g, b, a, w*2-5 as width, 13 as height from t join pixels p on p.image_id=t.image_id
            and p.x=((2*t.x+1)*w)//(2*(w*2-5)) and p.y=((2*t.y+1)*h)//26"""),
    "resample_lanczos": (
        lambda s, d: G.resample_lanczos(_sized(s, d), 3), SZ + "," + _lanczos_sql(3) + f"select {SCOLS} from lanczos"),
    "thumbnail": (
        lambda s, d: G.thumbnail(_sized(s, d), 20),
        SZ + "," + _thumbnail_sql("sized", 20)),
    "thumbnail_keep": (
        lambda s, d: G.thumbnail(_two_sizes(s, d), 20),
        SZ + """, mixed as (select image_id, y, x, r, g, b, a, case when image_id%2=0 then 16 else width end as width, case when image_id%2=0 then 12 else height end as height
            from sized where image_id%2=1 or (x<16 and y<12)),""" + _thumbnail_sql("mixed", 20)),
    "resample_lanczos_keep": (
        lambda s, d: G.resample_lanczos(_sized(s, d), F.when(F.col("image_id") % 2 == 0, 1).otherwise(2)),
        SZ.replace("sized as (", "all_sized as (") + ", sized as (select * from all_sized where image_id%2=1)," + _lanczos_sql(2)
        + f"select {SCOLS} from lanczos union all select {SCOLS} from all_sized where image_id%2=0"),
    "edit_image_width": (
        lambda s, d: G.edit_image(_sized(s, d), width=20),
        SZ + "," + _resample_sql("sized", "20", "height") + f"select {SCOLS} from scaled"),
    "edit_image": (
        lambda s, d: G.edit_image(_sized(s, d), 270, crop=(0.25, 0, 0.5, 1), width=24, height=40),
        SZ + """, rot as (select image_id, width-1-x as y, y as x, r, g, b, a, height as width, width as height from sized),
          cut as (select image_id, y, x-cast(floor(0.25::double*width+0.5) as int) as x, r, g, b, a, cast(floor(0.5::double*width+0.5) as int) as width, height from rot
            where x>=cast(floor(0.25::double*width+0.5) as int) and x<cast(floor(0.25::double*width+0.5) as int)+cast(floor(0.5::double*width+0.5) as int)),"""
        + _resample_sql("cut", "24", "40") + f"select {SCOLS} from scaled"),
    "icon_render": (
        lambda s, d: G.icon_render(_sized(s, d), 24),
        SZ + "," + _resample_sql("sized", "greatest(1,floor(width*least(24::double/width,24::double/height)+0.5))", "greatest(1,floor(height*least(24::double/width,24::double/height)+0.5))")
        + """, c as (select image_id, y, unnest(range(24)) as x from (select image_id, unnest(range(24)) as y from dims)),
          s as (select *, floor((24-width)/2.0::double+0.5) as ox, floor((24-height)/2.0::double+0.5) as oy from scaled)
          select c.image_id, cast(c.y as int) as y, cast(c.x as int) as x, coalesce(r,0) as r, coalesce(g,0) as g, coalesce(b,0) as b, coalesce(a,0) as a, 24 as width, 24 as height
            from c left join s on s.image_id=c.image_id and s.y+oy=c.y and s.x+ox=c.x"""),
    "margin_paint": (
        lambda s, d: G.margin_paint(_sized(s, d), "px", top=2, right=0, bottom=3, left=5, color="#c08040", opacity=60),
        SZ + """, c as (select image_id, width, height, y, unnest(range(width+5)) as x from (select *, unnest(range(height+5)) as y from dims))
          select c.image_id, cast(c.y as int) as y, cast(c.x as int) as x, coalesce(r,192) as r, coalesce(g,128) as g, coalesce(b,64) as b, coalesce(a,153) as a, c.width+5 as width, c.height+5 as height
            from c left join pixels p on p.image_id=c.image_id and p.y+2=c.y and p.x+5=c.x"""),
    "merge_images": (
        lambda s, d: _merged(s, d, "vertical", "center", "none", None).drop("out_name"),
        SZ + "," + MEMBERS + "select * from painted"),
    "merge_images_fill": (
        lambda s, d: _merged(s, d, "horizontal", "start", "fill", "#336699").drop("out_name"),
        SZ + "," + FILLED + _resample_sql("placed", "dw", "dh", "image_id, album, px, cw, ch") + f"""
          select album, y, cast(x+px as int) as x, {', '.join(f"cast((2*({c}*a+{v}*(255-a))+255)//510 as int) as {c}" for c, v in zip('rgb', (51, 102, 153)))},
            255 as a, cast(cw as int) as width, cast(ch as int) as height from scaled"""),
    "sharpen": (
        lambda s, d: N.sharpen(_px(s, d), 0.8), PX + "," + _sharpen_sql("pixels", 0.8) + "select * from sharp"),
    "sharpen_small_tiles": (
        lambda s, d: N.sharpen(_px(s, d), 0.35, tile=8), PX + "," + _sharpen_sql("pixels", 0.35) + "select * from sharp"),
    "gaussian_blur": (
        lambda s, d: N.gaussian_blur(_px(s, d), 1.5, tile=16), PX + "," + _blur_sql("pixels", 1.5) + f"select {PCOLS} from blurred"),
    "median3": (
        lambda s, d: N.median3(_px(s, d), tile=16),
        SZ + "," + MEDIAN + "select image_id, y, x, " + ", ".join(f"list_sort(list({c}))[5] as {c}" for c in "rgb") + ", any_value(a) as a from nb group by 1,2,3"),
    "mode5": (
        lambda s, d: N.mode5(_px(s, d), tile=16),
        PX + "," + MODE + "select p.image_id, p.y, p.x, coalesce(mr,r) as r, coalesce(mg,g) as g, coalesce(mb,b) as b, a from pixels p join wide using (image_id, y, x)"),
    "tile_grid": (
        lambda s, d: TI.tile_grid(P.image_dims(_px(s, d)), 16, 4).select(
            "image_id", "ty", "tx", "y0", "x0", "y1", "x1", "py0", "px0", "py1", "px1", "oy0", "ox0"),
        SZ + "," + TG + "select *, (y0-py0)*4 as oy0, (x0-px0)*4 as ox0 from grid"),
    "tile_grid_images": (
        lambda s, d: TI.tile_grid(X.images(s, d).select("image_id", "width", "height")).select(
            "image_id", "ty", "tx", "py0", "px0", "py1", "px1", "oy0", "ox0"),
        V.cte(V.IMAGES) + """, g as (select image_id, width, height, case when greatest(width,height)<=256 then 0 else 16 end as p, ty, unnest(range((width-1)//256+1)) as tx
            from (select *, unnest(range((height-1)//256+1)) as ty from images)),
          q as (select image_id, cast(ty as int) as ty, cast(tx as int) as tx, cast(greatest(ty*256-p,0) as int) as py0, cast(greatest(tx*256-p,0) as int) as px0,
            cast(least(least(ty*256+256,height)+p,height) as int) as py1, cast(least(least(tx*256+256,width)+p,width) as int) as px1 from g)
          select *, (ty*256-py0)*4 as oy0, (tx*256-px0)*4 as ox0 from q"""),
    "tile_explode": (
        lambda s, d: TI.tile_explode(_sized(s, d), 16, 4).drop("width", "height"),
        SZ + "," + TG + "select p.*, g.ty, g.tx from pixels p join grid g on g.image_id=p.image_id and y>=py0 and y<py1 and x>=px0 and x<px1"),
    "tile_stitch": (
        lambda s, d: TI.tile_stitch(TI.tile_explode(_sized(s, d), 16, 4), 16).drop("width", "height"), PX + "select * from pixels"),
    "tiled_inference": (
        lambda s, d: TI.tiled_inference(_sized(s, d), tile=16, pad=4),
        SZ + "," + _lanczos_sql(4) + "select l.image_id, l.y, l.x, p.r, p.g, p.b, l.a, l.width, l.height from lanczos l join pixels p on p.image_id=l.image_id and p.y=l.y//4 and p.x=l.x//4"),
}
