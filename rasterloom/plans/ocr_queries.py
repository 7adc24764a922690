"""Registered queries on text detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import ocr as O
from rasterloom.plans import views as V
from rasterloom.sources import fixtures as X

WCOLS = "image_id, pass, seq, text, confidence, left_px, top_px, width_px, height_px"
WORDS = f"""words as (select {', '.join(c for c in WCOLS.split(', ') if c not in ('text', 'confidence'))}, trim(text) as text, round_even(c,1) as confidence
  from (select *, coalesce(try_cast(conf as double), -1.0::double) as c from detections) where level=5 and trim(text)<>'' and c>=30.0)"""
BANDS = """tl as (select image_id, top_px, max(top_px+height_px) as bt from words group by 1,2),
  op as (select *, case when max(bt) over (partition by image_id order by top_px rows between unbounded preceding and 1 preceding) >= top_px then 0 else 1 end as o from tl),
  bn as (select image_id, top_px, sum(o) over (partition by image_id order by top_px) as band from op),
  bw as (select w.*, band from words w join bn using (image_id, top_px))"""
INTER = "(greatest(0,least({0}.l+{0}.w,{1}.l+{1}.w)-greatest({0}.l,{1}.l))*greatest(0,least({0}.t+{0}.h,{1}.t+{1}.h)-greatest({0}.t,{1}.t)))"
KEEP = f"""kb as (select image_id, band, list_reduce(list([{{'c':confidence,'p':pass,'s':seq,'x':text,'l':left_px,'t':top_px,'w':width_px,'h':height_px,'n':0}}] order by confidence desc, pass, seq),
    lambda acc, z: case when len(list_filter(acc, lambda k: 2*{INTER.format('k', 'z[1]')} > k.w*k.h+z[1].w*z[1].h-{INTER.format('k', 'z[1]')}))>0 then acc else list_concat(acc, z) end) as kept
  from bw group by 1,2),
  kw as (select image_id, band, unnest(kept) as k from kb),
  kept as (select image_id, band, k.p as pass, k.s as seq, k.x as text, k.c as confidence, k.l as left_px, k.t as top_px, k.w as width_px, k.h as height_px from kw)"""
LINES = """lb as (select image_id, band, list_reduce(list([{'c':confidence,'p':pass,'s':seq,'x':text,'l':left_px,'t':top_px,'w':width_px,'h':height_px,'n':0,'i':0}] order by top_px, left_px, confidence desc, pass, seq),
    lambda acc, z: list_append(acc, {'c':z[1].c,'p':z[1].p,'s':z[1].s,'x':z[1].x,'l':z[1].l,'t':z[1].t,'w':z[1].w,'h':z[1].h,
      'n': coalesce(list_min(list_transform(list_filter(acc, lambda k: 2*(k.t+k.h) >= 2*z[1].t+z[1].h), lambda k: k.n)), list_max(list_transform(acc, lambda k: k.n))+1), 'i': len(acc)})) as lined
  from kept group by 1,2),
  lw as (select image_id, band, unnest(lined) as k from lb),
  lo as (select image_id, band, coalesce(sum(n) over (partition by image_id order by band rows between unbounded preceding and 1 preceding),0) as f from (select image_id, band, max(k.n)+1 as n from lw group by 1,2)),
  lines as (select image_id, k.p as pass, k.s as seq, k.x as text, k.c as confidence, k.l as left_px, k.t as top_px, k.w as width_px, k.h as height_px, cast(f+k.n as int) as line, band, k.i as i from lw join lo using (image_id, band)),
  lt as (select image_id, line, string_agg(text, ' ' order by left_px, i) as text from lines group by 1,2),
  texts as (select image_id, string_agg(text, chr(10) order by line) as text from lt group by 1)"""

DET = V.cte(V.DETECTIONS, WORDS)
ALL = V.cte(V.DETECTIONS, WORDS, BANDS, KEEP, LINES)


def _words(s, d):
    return O.ocr_filter(X.detections(s, d))


def _kept(s, d):
    return O.ocr_dedup(_words(s, d))


def _lines(s, d, limit=O.BAND_LIMIT):
    """Duplicates, then lines, of words packed once."""
    words = O.gathered(_words(s, d))
    return O.ocr_lines(O.ocr_dedup(words), limit, words.sizes)


def _texts(s, d):
    return O.ocr_text(_words(s, d))


def _named(s, d):
    return X.images(s, d).select("image_id", "album", "pos", "file_name")


def _ocr_images(s, d):
    return X.images(s, d).select("image_id", "file_name").join(X.ocr_sizes(s, d), "image_id")


def _result(s, d):
    """Words and texts of one page table, which is gathered once."""
    return O.ocr_result(_ocr_images(s, d), O.ocr_page(_words(s, d)))


RIVALS = V.cte(V.DETECTIONS, WORDS, BANDS) + f""", c as (select image_id, band, left_px as l, top_px as t, width_px as w, height_px as h, count(*) as n, min({{'p': pass, 's': seq}}) as rep from bw group by all),
          m as (select a.image_id, a.rep, max({{'i': {INTER.format('a', 'b')}/(a.w*a.h+b.w*b.h-{INTER.format('a', 'b')})::double, 'p': -b.rep.p, 's': -b.rep.s}}) as r
            from c a join c b on a.image_id=b.image_id and a.band=b.band and a.rep<>b.rep and 2*{INTER.format('a', 'b')}>a.w*a.h+b.w*b.h-{INTER.format('a', 'b')} group by 1, 2)
          select bw.image_id, pass, seq, c.rep.p as class_pass, c.rep.s as class_seq, c.n as class_words, -m.r.p as rival_pass, -m.r.s as rival_seq, round(m.r.i, 6) as iou
          from bw join c on bw.image_id=c.image_id and left_px=l and top_px=t and width_px=w and height_px=h left join m on m.image_id=c.image_id and m.rep=c.rep"""


QUERIES = {
    "ocr_filter": (_words, DET + f"select {WCOLS} from words"),
    "ocr_union_passes": (
        lambda s, d: O.ocr_union_passes(
            O.ocr_filter(X.detections(s, d).filter("pass = 0")), O.ocr_filter(X.detections(s, d).filter("pass = 1"))
        ),
        DET + f"select {WCOLS} from words"),
    "iou_pairs": (
        lambda s, d: O.iou_links(_words(s, d)).withColumn("iou", F.round("iou", 6)),
        V.cte(V.DETECTIONS, WORDS, BANDS) + f""", p as (select image_id, band, pass, seq, left_px as l, top_px as t, width_px as w, height_px as h from bw)
          select a.image_id, a.pass as pass_a, a.seq as seq_a, b.pass as pass_b, b.seq as seq_b,
            round({INTER.format('a', 'b')}/(a.w*a.h+b.w*b.h-{INTER.format('a', 'b')})::double,6) as iou
          from p a join p b on a.image_id=b.image_id and a.band=b.band and (a.pass<b.pass or (a.pass=b.pass and a.seq<b.seq))
            and 2*{INTER.format('a', 'b')}>a.w*a.h+b.w*b.h-{INTER.format('a', 'b')}"""),
    # The index of boxes that touch too many others, forced for all.
    "iou_pairs_indexed": (lambda s, d: O.iou_pairs(_words(s, d), 0).withColumn("iou", F.round("iou", 6)), RIVALS),
    "ocr_dedup": (_kept, V.cte(V.DETECTIONS, WORDS, BANDS, KEEP) + f"select {WCOLS} from kept"),
    "reading_order": (
        lambda s, d: O.reading_order(_words(s, d)).select("image_id", "pass", "seq", "reading_pos"),
        DET + "select image_id, pass, seq, row_number() over (partition by image_id order by top_px, left_px, confidence desc, pass, seq) as reading_pos from words"),
    "ocr_page": (lambda s, d: O.ocr_page(_words(s, d)), ALL + f"select {WCOLS}, line from lines"),
    "ocr_page_rounds": (lambda s, d: O.ocr_page(_words(s, d), 12), ALL + f"select {WCOLS}, line from lines"),
    "ocr_lines": (_lines, ALL + f"select {WCOLS}, line from lines"),
    "ocr_text": (_texts, ALL + "select image_id, text from texts"),
    # The routes that bands of any size take, forced for all bands.
    "ocr_dedup_rounds": (lambda s, d: O.ocr_dedup(_words(s, d), 0), V.cte(V.DETECTIONS, WORDS, BANDS, KEEP) + f"select {WCOLS} from kept"),
    "ocr_lines_streamed": (lambda s, d: _lines(s, d, 0), ALL + f"select {WCOLS}, line from lines"),
    "ocr_fractions": (
        lambda s, d: O.ocr_fractions(_words(s, d), X.ocr_sizes(s, d)).selectExpr(
            "image_id", "pass", "seq", "left", "top", "box_width", "box_height"),
        V.cte(V.DETECTIONS, WORDS, V.OCR_SIZES) + """select image_id, pass, seq, left_px/greatest(1,width)::double as "left", top_px/greatest(1,height)::double as top,
          width_px/greatest(1,width)::double as box_width, height_px/greatest(1,height)::double as box_height from words join ocr_sizes using (image_id)"""),
    "ocr_result": (
        lambda s, d: _result(s, d).select(
            "image_id", "file_name", "width", "height", "text", F.size("words").alias("n_words"),
            F.array_join(F.transform("words", lambda w: F.concat(w["line"].cast("string"), F.lit(":"), w["text"])), "|").alias("flat")),
        V.cte(V.DETECTIONS, WORDS, BANDS, KEEP, LINES, V.OCR_SIZES, V.IMAGES) + """, f as (select image_id, count(*) as n,
            string_agg(concat(cast(line as varchar),':',text), '|' order by line, left_px, i) as flat from lines group by 1)
          select i.image_id, i.file_name, s.width, s.height, coalesce(t.text,'') as text, cast(coalesce(n,0) as int) as n_words, coalesce(flat,'') as flat
            from images i join ocr_sizes s using (image_id) left join texts t using (image_id) left join f using (image_id)"""),
    "char_count": (
        lambda s, d: O.char_count(_texts(s, d)).select("image_id", "n_chars"), ALL + r"select image_id, cast(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) as int) as n_chars from texts"),
    "text_names": (
        lambda s, d: O.text_names(_named(s, d)).select("album", "image_id", "text_name"),
        V.cte(V.IMAGES) + """, t as (select album, image_id, pos, regexp_replace(file_name,'\\.[^/.]+$','') as stem from images),
          k as (select *, row_number() over (partition by album, stem order by pos) as k from t)
          select album, image_id, case when k=1 then concat(stem,'.txt') else concat(stem,'-',cast(k as varchar),'.txt') end as text_name from k"""),
}
