"""Queries over predictions of several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import ensemble as e
from pagefold.sources import views as v

IOU = "coalesce(greatest(least({a}.r, {b}.r) - greatest({a}.l, {b}.l), 0) * greatest(least({a}.b, {b}.b) - greatest({a}.t, {b}.t), 0) / nullif(({a}.r - {a}.l) * ({a}.b - {a}.t) + ({b}.r - {b}.l) * ({b}.b - {b}.t) - greatest(least({a}.r, {b}.r) - greatest({a}.l, {b}.l), 0) * greatest(least({a}.b, {b}.b) - greatest({a}.t, {b}.t), 0), 0), 0)"
SMALL = "greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) / least((a.r - a.l) * (a.b - a.t), (b.r - b.l) * (b.b - b.t))"
GROUPS = f"""{v.FIELDS}, numbered as (
  select *, row_number() over (partition by docid, fieldtype, page, li order by k, pos) as rn from fields
), steps as (
  select docid, fieldtype, page, li, rn, k, pos, l, t, r, b, score, 0 as g, [{{'l': l, 't': t, 'r': r, 'b': b, 'g': 0}}] as st from numbered where rn = 1
  union all
  select n.docid, n.fieldtype, n.page, n.li, n.rn, n.k, n.pos, n.l, n.t, n.r, n.b, n.score, x.g, list_append(s.st, {{'l': n.l, 't': n.t, 'r': n.r, 'b': n.b, 'g': x.g}})
  from steps s join numbered n on n.docid = s.docid and n.fieldtype = s.fieldtype and n.page = s.page and n.li is not distinct from s.li and n.rn = s.rn + 1,
  lateral (select coalesce(list_min(list_transform(list_filter(s.st, lambda y: {IOU.format(a='y', b='n')} >= 0.5), lambda y: y.g)), list_max(list_transform(s.st, lambda y: y.g)) + 1) as g) x
)"""


def _merged(mode, weights=None):
    return lambda spark, d: e.merge(v.fields(spark, d), 3, weights, 0.5, mode)


def _merged_sql(score, weight="1.0"):
    return f"""with recursive {GROUPS}, w as (select *, {weight} as weight from steps),
s as (select docid, fieldtype, page, li, g, k, weight, max(score) as best from w group by all),
c as (select docid, fieldtype, page, li, g, {score} as score, count(*) as n_sources from s group by all),
f as (select distinct on (docid, fieldtype, page, li, g) docid, fieldtype, page, li, g, l, t, r, b from w order by docid, fieldtype, page, li, g, score * weight desc, k, pos)
select f.*, c.score, c.n_sources from f join c on f.docid = c.docid and f.fieldtype = c.fieldtype and f.page = c.page and f.li is not distinct from c.li and f.g = c.g"""


WEIGHTS = [1.0, 0.5, 0.75]
WEIGHT_SQL = "case k when 0 then 1.0 when 1 then 0.5 else 0.75 end::double"

QUERIES = {
    "ensemble_weighted_max": _merged("weighted_max"),
    "ensemble_weighted_mean": _merged("weighted_mean", WEIGHTS),
    "ensemble_vote": _merged("vote"),
    "self_consistency_vote": lambda s, d: e.self_consistency(v.fields(s, d), 3),
    "dedup_argmax": lambda s, d: e.best_of_page(v.fields(s, d), ["RF"]),
    "replace_by_type": lambda s, d: e.replace_types(v.fields(s, d).where("k = 0"), v.fields(s, d).where("k = 1 and score > 0.9"), ["RF", "AF"]),
    "docid_coverage": lambda s, d: e.cover(v.read(s, d, "part").select(F.col("p_partkey").alias("docid")), v.fields(s, d).where("score > 0.98")),
    "page_and_row_fields": lambda s, d: _split_counts(v.fields(s, d)),
}


def _split_counts(fields):
    page, rows = e.split_rows(fields)
    count = lambda df, task: df.groupBy("docid").agg(F.count("*").alias("n")).withColumn("task", F.lit(task))
    return count(page, "page").unionByName(count(rows, "row"))


SQL = {
    "ensemble_weighted_max": _merged_sql("least(max(best * weight), 1.0)", "1.0::double"),
    "ensemble_weighted_mean": _merged_sql("sum(best * weight) / sum(weight)", WEIGHT_SQL),
    "ensemble_vote": _merged_sql("least(case when count(*) = 3 then 1.0::double else sum(weight) / 3 end, 1.0)", "1.0::double"),
    "self_consistency_vote": f"""with {v.FIELDS}, j as (
  select a.docid, a.fieldtype, a.page, a.pos, a.l, a.t, a.r, a.b, a.score as own, count(distinct b.k) + 1 as votes, max(b.score) as other
  from (select * from fields where k = 0) a left join (select * from fields where k > 0) b
    on a.docid = b.docid and a.fieldtype = b.fieldtype and a.page = b.page and {SMALL} >= 0.3 group by all)
select docid, fieldtype, page, pos, l, t, r, b, votes, least(votes / 3, greatest(own, coalesce(other, 0))) as score from j where votes >= 2""",
    "dedup_argmax": f"""with {v.FIELDS}, x as (select *, row_number() over (partition by docid, fieldtype, page, li is null order by score desc, k, pos) as rank from fields)
select * exclude (rank) from x where li is not null or fieldtype = 'RF' or rank = 1""",
    "replace_by_type": f"""with {v.FIELDS}, n as (select * from fields where k = 1 and score > 0.9 and fieldtype in ('RF', 'AF'))
select * from fields f where k = 0 and not exists (select 1 from n where n.docid = f.docid and n.fieldtype = f.fieldtype) union all select * from n""",
    "docid_coverage": f"with {v.FIELDS} select p_partkey as docid, count(fields.docid) as n_fields from part left join fields on p_partkey = docid and score > 0.98 group by 1",
    "page_and_row_fields": f"with {v.FIELDS} select docid, case when li is null then 'page' else 'row' end as task, count(*) as n from fields group by all",
}
