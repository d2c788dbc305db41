"""Queries that join words, boxes and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import joins as j
from pagefold.plans.ensembles import IOU, SMALL
from pagefold.sources import views as v

#: Boxes of four by one cells over each page's first eight rows and columns, in three labels.
_REGIONS = """select docid, page, cast(k as int) as ord, concat('L', cast(k % 3 as string)) as label, k * 0.0625 as l, (k % 4) * 0.03125 - 0.0009765625 as t,
  k * 0.0625 + 0.125 * (1 + k % 2) as r, (k % 4) * 0.03125 + 0.015625 as b from {pages}"""
REGIONS = "regions as (select docid, page, cast(k as int) as ord, concat('L', k % 3) as label, (k * 0.0625)::double as l, ((k % 4) * 0.03125 - 0.0009765625)::double as t, (k * 0.0625 + 0.125 * (1 + k % 2))::double as r, ((k % 4) * 0.03125 + 0.015625)::double as b from (select distinct docid, page from words), range(8) x(k))"
#: Threes of words, side by side, so that every word is in one.
SPANS = """spans as (select docid, page, word_id as span_id, [word_id, word_id + 1, word_id + 2] as word_ids from words where word_id % 3 = 0)"""
BOXED = """boxed as (select s.docid, s.page, s.span_id, any_value(s.word_ids) as word_ids, min(w."left") as l, min(w.top) as t, max(w."right") as r, max(w.bottom) as b
  from spans s join words w on w.docid = s.docid and w.page = s.page and list_contains(s.word_ids, w.word_id) group by 1, 2, 3)"""
VOCABULARY = "the of is ou er la de et un ti".split()
PAIRS = [("AF", "RF"), ("NO", "RF"), ("NF", "NO")]
#: For boxed spans, the nearest words around them; and the nearest word of a vocabulary.
AROUND = """pairs as (select x.docid, x.page, span_id, word_id, text, (w."left" + w."right") / 2 as wx, (w.top + w.bottom) / 2 as wy, x.l, x.t, x.r, x.b, w."left" as wl, w.top as wt, w."right" as wr, w.bottom as wb,
    abs((w.top + w.bottom) / 2 - (x.t + x.b) / 2) <= 0.045::double as level from boxed x join words w on w.docid = x.docid and w.page = x.page and not list_contains(word_ids, word_id)),
  nearest as (select docid, page, span_id, arg_min(text, (l - wr, word_id)) filter (level and wx < l) as p, arg_min(text, (wl - r, word_id)) filter (level and wx > r) as q,
    arg_min(text, (t - wb, word_id)) filter (not level and wy < t) as u, arg_min(text, (wt - b, word_id)) filter (not level and wy > b) as v from pairs group by all),
  around as (select docid, page, span_id, coalesce(p, '') as left_text, coalesce(q, '') as right_text, coalesce(u, '') as above_text, coalesce(v, '') as below_text from boxed left join nearest using (docid, page, span_id))"""


def near_sql(vocabulary) -> str:
    return f"""said as (select docid, page, word_id, trim(lower(text)) as label, ("left" + "right") / 2 as wx, (top + bottom) / 2 as wy from words where trim(lower(text)) in {tuple(vocabulary)}),
  told as (select x.docid, x.page, span_id, min((sqrt((wx - (l + r) / 2) * (wx - (l + r) / 2) + (wy - (t + b) / 2) * (wy - (t + b) / 2)), word_id, label)) as m from boxed x join said w on w.docid = x.docid and w.page = x.page and not list_contains(word_ids, word_id) group by all),
  near as (select docid, page, span_id, coalesce(m[3], '') as label, least(coalesce(m[1], 2), 2)::double as dist from boxed left join told using (docid, page, span_id))"""


CX, CY = '(w."left" + w."right") / 2', "(w.top + w.bottom) / 2"
INSIDE = f"{CX} between x.l and x.r and {CY} between x.t and x.b"


def regions(spark, d):
    pages = v.pages(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = spark.sql(_REGIONS, pages=pages)
    return out.select("docid", "page", "ord", "label", *(F.col(c).cast("double").alias(c) for c in "ltrb"))


def spans(spark, d):
    w = v.words(spark, d).where("word_id % 3 = 0")
    return w.select("docid", "page", F.col("word_id").alias("span_id"), F.sequence("word_id", F.col("word_id") + 2).alias("word_ids"))


def boxed(spark, d):
    s = spans(spark, d)
    b = j.union_of_words(s, v.words(spark, d), ["span_id"]).select("docid", "page", "span_id", F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))
    return s.join(b, ["docid", "page", "span_id"])


def _labels(spark, d):
    w = v.words(spark, d).where(F.lower("text").isin(VOCABULARY))
    return w.select("docid", "page", F.col("word_id").alias("label_id"), F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))


def _conflicts(spark, d):
    return j.conflict_pairs(v.fields(spark, d).where("k = 0"), PAIRS, 0.2, 0.3)


def _new_old(spark, d):
    f = v.fields(spark, d)
    return f.where("k = 1"), f.where("k = 0")


QUERIES = {
    "word_union_bbox": lambda s, d: j.union_of_words(spans(s, d), v.words(s, d), ["span_id"]),
    "words_in_box": lambda s, d: j.words_in_boxes(v.words(s, d), regions(s, d)).select("docid", "page", "ord", "word_id"),
    "words_in_box_margin": lambda s, d: j.words_in_boxes(v.words(s, d), regions(s, d), 0.005).groupBy("docid", "page", "ord").agg(F.count("*").alias("n")),
    "snap_to_words": lambda s, d: j.snap_to_words(regions(s, d), v.words(s, d), ["ord"]),
    "smallest_region": lambda s, d: j.smallest_region(v.words(s, d), regions(s, d)).select("docid", "page", "word_id", "region"),
    "region_noise_filter": lambda s, d: j.drop_noise(j.smallest_region(v.words(s, d), regions(s, d)), ["L1"]).groupBy("docid").agg(F.count("*").alias("n")),
    "iou_pairs": lambda s, d: j.best_iou(*_new_old(s, d), 0.0),
    "existing_overlap_antijoin": lambda s, d: j.without_overlap(*_new_old(s, d), 0.9).select("docid", "fieldtype", "page", "pos", "score"),
    "best_iou_replace": lambda s, d: j.replace_by_iou(*reversed(_new_old(s, d)), 0.5),
    "overlap_demote": lambda s, d: j.demote_overlaps(v.fields(s, d).where("k = 0")).select("docid", "page", "pos", "score"),
    "conflict_pairs": _conflicts,
    "conflict_stats": lambda s, d: j.conflict_stats(_conflicts(s, d), F.col("pos_a") % 2 == 0),
    "conflict_resolution": lambda s, d: j.drop_losers(v.fields(s, d).where("k = 0"), _conflicts(s, d).withColumn("score_a", (F.col("pos_a") % 10) / 10).withColumn("score_b", (F.col("pos_b") % 10) / 10)).select("docid", "page", "pos"),
    "directional_neighbors": lambda s, d: j.directional(_labels(s, d), v.words(s, d)).select("docid", "page", "label_id", "word_id", "way", "rank", "score"),
    "four_neighbors": lambda s, d: j.neighbours(boxed(s, d), v.words(s, d)),
    "nearest_label": lambda s, d: j.nearest_label(spans(s, d), v.words(s, d), VOCABULARY),
    "lir_fallback": lambda s, d: j.fall_back(*(f.where(t).select("docid", "page", "pos", "k") for f, t in zip([v.fields(s, d)] * 2, ("k = 1 and score > 0.9", "k = 0"), strict=True)), ["docid", "page"]),
    "first_page_found": lambda s, d: j.first_page(v.fields(s, d).groupBy("docid", "fieldtype", "page").agg(F.max("score").alias("score")), ["docid", "fieldtype"]),
    "occurrence_assign": lambda s, d: j.occurrences(v.read(s, d, "lineitem").select(F.col("l_orderkey").alias("docid"), F.col("l_linestatus").alias("fieldtype"), F.col("l_returnflag").alias("text"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord")).distinct(), v.read(s, d, "lineitem").select(F.col("l_orderkey").alias("docid"), F.col("l_linestatus").alias("fieldtype"), F.col("l_returnflag").alias("text"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("place")).where("l_linenumber < 5").distinct()).select("docid", "fieldtype", "text", "n", "ord.l_linenumber", F.col("place.l_partkey").alias("partkey")),
}

_W = f"with {v.WORDS}"
SQL = {
    "word_union_bbox": f"""{_W}, {SPANS} select s.docid, s.page, s.span_id, min(w."left") as "left", min(w.top) as top, max(w."right") as "right", max(w.bottom) as bottom, string_agg(w.text, ' ' order by w.word_id) as text
from spans s join words w on w.docid = s.docid and w.page = s.page and list_contains(s.word_ids, w.word_id) group by 1, 2, 3""",
    "words_in_box": f"{_W}, {REGIONS} select w.docid, w.page, x.ord, w.word_id from words w join regions x on w.docid = x.docid and w.page = x.page and {INSIDE}",
    "words_in_box_margin": f"{_W}, {REGIONS} select w.docid, w.page, x.ord, count(*) as n from words w join regions x on w.docid = x.docid and w.page = x.page and {CX} between x.l - 0.005::double and x.r + 0.005::double and {CY} between x.t - 0.005::double and x.b + 0.005::double group by all",
    "snap_to_words": f"""{_W}, {REGIONS}, h as (select x.docid, x.page, x.ord, min(w."left") as l2, min(w.top) as t2, max(w."right") as r2, max(w.bottom) as b2, string_agg(w.text, ' ' order by w.word_id) as text from words w join regions x on w.docid = x.docid and w.page = x.page and {INSIDE} group by 1, 2, 3)
select x.docid, x.page, x.ord, coalesce(l2, l) as "left", coalesce(t2, t) as top, coalesce(r2, r) as "right", coalesce(b2, b) as bottom, text from regions x left join h on h.docid = x.docid and h.page = x.page and h.ord = x.ord""",
    "smallest_region": f"""{_W}, {REGIONS}, n as (select w.docid, w.page, w.word_id, arg_min(x.label, (x.r - x.l) * (x.b - x.t) * 1000 + x.ord * 1e-9) as region from words w join regions x on w.docid = x.docid and w.page = x.page and {INSIDE} group by 1, 2, 3)
select docid, page, word_id, coalesce(region, 'Text') as region from words left join n using (docid, page, word_id)""",
    "region_noise_filter": f"""{_W}, {REGIONS}, n as (select w.docid, w.page, w.word_id, arg_min(x.label, (x.r - x.l) * (x.b - x.t) * 1000 + x.ord * 1e-9) as region from words w join regions x on w.docid = x.docid and w.page = x.page and {INSIDE} group by 1, 2, 3)
select docid, count(*) as n from words left join n using (docid, page, word_id) where coalesce(region, 'Text') <> 'L1' group by 1""",
    "iou_pairs": f"""with {v.FIELDS}, p as (select a.docid, a.fieldtype, a.page, a.pos, {IOU.format(a='a', b='b')} as iou, b.pos as old_pos from fields a join fields b on a.k = 1 and b.k = 0 and a.docid = b.docid and a.fieldtype = b.fieldtype and a.page = b.page),
q as (select distinct on (docid, fieldtype, page, pos) * from p where iou > 0 order by docid, fieldtype, page, pos, iou desc, old_pos)
select f.docid, f.fieldtype, f.page, f.pos, iou, old_pos from (select * from fields where k = 1) f left join q using (docid, fieldtype, page, pos)""",
    "existing_overlap_antijoin": f"with {v.FIELDS} select docid, fieldtype, page, pos, score from fields a where k = 1 and not exists (select 1 from fields b where b.k = 0 and a.docid = b.docid and a.fieldtype = b.fieldtype and a.page = b.page and {IOU.format(a='a', b='b')} > 0.9)",
    "best_iou_replace": f"""with {v.FIELDS}, p as (select a.docid, a.fieldtype, a.page, a.pos, {IOU.format(a='a', b='b')} as iou, b.pos as old_pos from fields a join fields b on a.k = 1 and b.k = 0 and a.docid = b.docid and a.fieldtype = b.fieldtype and a.page = b.page),
q as (select distinct on (docid, fieldtype, page, pos) * from p where iou >= 0.5 order by docid, fieldtype, page, pos, iou desc, old_pos),
h as (select distinct on (docid, fieldtype, page, old_pos) * from q order by docid, fieldtype, page, old_pos, iou desc, pos)
select o.docid, o.fieldtype, o.page, o.pos, coalesce(n.l, o.l) as l, coalesce(n.t, o.t) as t, coalesce(n.r, o.r) as r, coalesce(n.b, o.b) as b, coalesce(n.score, o.score) as score
from (select * from fields where k = 0) o left join h on h.docid = o.docid and h.fieldtype = o.fieldtype and h.page = o.page and h.old_pos = o.pos
left join (select * from fields where k = 1) n on n.docid = h.docid and n.fieldtype = h.fieldtype and n.page = h.page and n.pos = h.pos""",
    "overlap_demote": f"""with {v.FIELDS}, x as (select * from fields where k = 0 and li is null), p as (select a.docid, a.page, unnest([a.pos, b.pos]) as pos from x a join x b on a.docid = b.docid and a.page = b.page and a.pos < b.pos and a.fieldtype <> b.fieldtype and {SMALL} >= 0.5)
select docid, page, pos, case when (docid, page, pos) in (select docid, page, pos from p) then score * 0.5 else score end as score from fields where k = 0""",
}
_PAIR = f"""with {v.FIELDS}, x as (select * from fields where k = 0), c as (select a.docid, a.page, a.pos as pos_a, b.pos as pos_b, concat(least(a.fieldtype, b.fieldtype), '|', greatest(a.fieldtype, b.fieldtype)) as pair
  from x a join x b on a.docid = b.docid and a.page = b.page and a.pos < b.pos and {SMALL} >= 0.3 and abs(a.score - b.score) < 0.2 where pair in ('AF|RF', 'NO|RF', 'NF|NO'))"""
SQL |= {
    "conflict_pairs": f"{_PAIR} select * from c",
    "conflict_stats": f"{_PAIR} select pair, count(*) as triggered, cast(count_if(pos_a % 2 = 0) as bigint) as resolved from c group by 1",
    "conflict_resolution": f"{_PAIR}, n as (select docid, page, case when pos_a % 10 / 10 < pos_b % 10 / 10 then pos_a else pos_b end as pos from c where abs(pos_a % 10 / 10 - pos_b % 10 / 10) >= 0.15) select docid, page, pos from x where (docid, page, pos) not in (select docid, page, pos from n)",
    "directional_neighbors": f"""{_W}, lab as (select docid, page, word_id as label_id, "left" as l, top as t, "right" as r, bottom as b from words where lower(text) in {tuple(VOCABULARY)}),
n as (select x.docid, x.page, label_id, word_id, w."left" - r as dist, 0 as way from lab x join words w on w.docid = x.docid and w.page = x.page and w."left" - r between 0 and 0.2::double and abs(w.top - t) <= 0.03::double
  union all select x.docid, x.page, label_id, word_id, w.top - b, 1 from lab x join words w on w.docid = x.docid and w.page = x.page and w.top - b between 0 and 0.2::double and abs(w."left" - l) <= 0.3::double),
k as (select *, cast(row_number() over (partition by docid, page, label_id order by dist, word_id, way) as int) as rank from n)
select docid, page, label_id, word_id, way, rank, greatest(0.1::double, 0.75::double - 2 * dist) as score from k where rank <= 3""",
    "four_neighbors": f"""{_W}, {SPANS}, {BOXED}, {AROUND} select docid, page, span_id, left_text, right_text, above_text, below_text from around""",
    "nearest_label": f"""{_W}, {SPANS}, {BOXED}, {near_sql(VOCABULARY)} select docid, page, span_id, label, dist from near""",
    "lir_fallback": f"with {v.FIELDS}, n as (select docid, page, pos, k from fields where k = 1 and score > 0.9) select * from n union all select docid, page, pos, k from fields where k = 0 and (docid, page) not in (select docid, page from n)",
    "first_page_found": f"with {v.FIELDS}, m as (select docid, fieldtype, page, max(score) as score from fields group by all) select distinct on (docid, fieldtype) docid, fieldtype, page, score from m order by docid, fieldtype, page",
    "occurrence_assign": """with x as (select distinct l_orderkey as docid, l_linestatus as fieldtype, l_returnflag as text, l_linenumber, l_partkey, l_suppkey from lineitem),
a as (select *, cast(row_number() over (partition by docid, fieldtype, text order by l_linenumber, l_partkey, l_suppkey) as int) as n from x),
b as (select *, cast(row_number() over (partition by docid, fieldtype, text order by l_partkey, l_suppkey, l_linenumber) as int) as n from x where l_linenumber < 5)
select docid, fieldtype, text, n, a.l_linenumber, b.l_partkey as partkey from a join b using (docid, fieldtype, text, n)""",
}
