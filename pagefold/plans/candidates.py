"""Queries of candidates, sets of types, code extractors, parsed answers and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import align as al
from pagefold.operators import ensemble as e
from pagefold.sources import parsing
from pagefold.sources import views as v
from pagefold.streaming import incremental

#: cluster (a language), fieldtype, label, pattern, reach
RULES = [("en", "notes", "the", "^[a-z]{6,}$", 2), ("de", "notes", "und", "^[a-z]{6,}$", 2), ("es", "code", "la", "[0-9]", 4), ("fr", "code", "la", "[0-9]", 4)]
TYPES = ["AF", "RF", "NO"]


def _ids(fields):
    return fields.withColumn("word_ids", F.array((F.col("pos") % 5).cast("int"), (F.col("pos") % 3).cast("int")))


def _texts(fields):
    return fields.withColumn("text", F.concat(F.lit("n "), (F.col("pos") % 4).cast("string"), F.col("fieldtype")))


def _grounding(s, d):
    entry = F.struct(F.concat(F.lit("t"), F.col("pos").cast("string")).alias("text"), F.transform(F.array(*"ltrb"), lambda x: x * 10).alias("bbox_2d"))
    f = v.fields(s, d).where("k = 0").groupBy("docid", "page", "fieldtype").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es"))
    value = F.when(F.size("es") == 1, F.to_json(F.col("es")[0]["e"])).otherwise(F.to_json(F.transform("es", lambda x: x["e"])))
    member = F.concat(F.lit('"'), "fieldtype", F.lit('":'), value)
    return f.groupBy("docid", "page").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(member), ","), F.lit("}")).alias("raw"))


def _lenient(s, d):
    """A third of the answers in a fence within prose, a third in bare prose, a third without JSON."""
    json, kind = F.to_json(F.struct("pos")), F.col("docid") % 3
    raw = F.when(kind == 0, F.concat(F.lit("So:\n```json\n"), json, F.lit("\n```\nwell {"))).when(kind == 1, F.concat(F.lit("I find "), json, F.lit(" there"))).otherwise("nothing here")
    rows = v.fields(s, d).where("k = 0").select("docid", "pos", raw.alias("raw"))
    return rows.select("docid", "pos", F.from_json(parsing.lenient(F.col("raw")), "pos long")["pos"].alias("found"))


def _verdicts(s, d):
    verdict = F.element_at(F.array(*map(F.lit, ("accept", "correct", "reject", "maybe"))), (F.col("pos") % 4 + 1).cast("int"))
    json = F.to_json(F.struct(verdict.alias("verdict"), F.array((F.col("pos") % 7).cast("int")).alias("word_ids"), F.col("score").alias("confidence")))
    rows = v.fields(s, d).where("k = 0").select("docid", F.col("pos").alias("ord"), F.when(F.col("pos") % 5 == 0, "no JSON").otherwise(json).alias("raw"), F.array(*map(F.lit, range(5))).alias("valid"))
    return parsing.verdicts(rows).select("docid", "ord", "verdict", F.array_join("ids", ",").alias("ids"), "confidence")


def _pages(s, d):
    f = v.fields(s, d).where("k = 0").groupBy("docid", "page", "fieldtype").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    rows = f.select("docid", "page", "fieldtype", F.transform("ps", lambda x: x.cast("string")).alias("texts"), (F.size("ps") > 1).alias("listed"))
    return parsing.merge_pages(rows).select("docid", "fieldtype", F.array_join("texts", ",").alias("texts"))


def _rules(s, d):
    docs = v.read(s, d, "documents").select(F.col("doc_id").alias("docid"), F.col("lang").alias("cluster"))
    return al.apply_rules(v.words(s, d), s.createDataFrame(RULES, "cluster string, fieldtype string, label string, pattern string, reach int"), docs)


def _strong(s, d, k, least):
    return v.fields(s, d).where(f"k = {k} and score > {least}")


QUERIES = {
    "candidate_dedup": lambda s, d: e.best_of_words(_ids(v.fields(s, d))).select("docid", "page", F.array_join("ids", ",").alias("ids"), "score", "place"),
    "oracle_dedup": lambda s, d: e.best_of_text(_texts(v.fields(s, d))),
    "prediction_union": lambda s, d: _strong(s, d, 0, 0).unionByName(_strong(s, d, 1, 0.6)).unionByName(_strong(s, d, 2, 0.9)).select("docid", "fieldtype", "page", "k", "pos", "score"),
    "source_docids": lambda s, d: e.in_sources(v.fields(s, d).where("score > 0.9"), 3),
    "type_sets": lambda s, d: e.type_sets(_strong(s, d, 0, 0.9), _strong(s, d, 1, 0.9)),
    "script_fallback": lambda s, d: al.prefer(_strong(s, d, 1, 0.95), _strong(s, d, 0, 0)).select("docid", "k", "pos", "score"),
    "parse_grounding_json": lambda s, d: parsing.grounded(_grounding(s, d), TYPES).select("docid", "page", "fieldtype", "text", *(F.round(x, 6).alias(x) for x in "ltrb")),
    "parse_lenient_json": _lenient,
    "parse_verdicts": _verdicts,
    "merge_pages": _pages,
    "script_rules": _rules,
    "resumable_batch": lambda s, d: incremental.remaining(v.read(s, d, "part").select(F.col("p_partkey").alias("docid")), _strong(s, d, 0, 0.95)),
}
_F = f"with {v.FIELDS}"
SQL = {
    "candidate_dedup": f"{_F}, b as (select docid, page, list_sort(list_distinct([pos % 5, pos % 3])) as ids, max(score) as score from fields group by all) select docid, page, array_to_string(ids, ',') as ids, score, cast(row_number() over (partition by docid order by score desc, page, ids) as int) as place from b",
    "oracle_dedup": f"{_F}, x as (select *, concat('N', pos % 4, fieldtype) as code from fields) select distinct on (docid, fieldtype, code) docid, fieldtype, code, page, k, pos, score from x order by docid, fieldtype, code, score desc, page, k, pos",
    "prediction_union": f"{_F} select docid, fieldtype, page, k, pos, score from fields where score > case k when 0 then 0 when 1 then 0.6::double else 0.9::double end",
    "source_docids": f"{_F}, x as (select * from fields where score > 0.9::double) select docid, coalesce(a.n, 0) as n0, coalesce(b.n, 0) as n1, coalesce(c.n, 0) as n2 from (select docid, count(*) as n from x where k = 0 group by 1) a full join (select docid, count(*) as n from x where k = 1 group by 1) b using (docid) full join (select docid, count(*) as n from x where k = 2 group by 1) c using (docid)",
    "type_sets": f"""{_F}, a as (select distinct docid, fieldtype from fields where k = 0 and score > 0.9::double), b as (select distinct docid, fieldtype from fields where k = 1 and score > 0.9::double)
select *, 'a' as side from (from a except from b) union all select *, 'b' from (from b except from a) union all select *, 'both' from (from a intersect from b)""",
    "script_fallback": f"""{_F}, g as (select * from fields where k = 1 and score > 0.95::double and li is null)
select docid, k, pos, score from g union all select docid, k, pos, score from fields f where k = 0 and (li is not null or not exists (select 1 from g where g.docid = f.docid))""",
    "parse_grounding_json": f"{_F} select docid, page, fieldtype, concat('t', pos) as text, round(l * 10 / 1000, 6) as l, round(t * 10 / 1000, 6) as t, round(r * 10 / 1000, 6) as r, round(b * 10 / 1000, 6) as b from fields where k = 0 and fieldtype in ('AF', 'RF', 'NO')",
    "parse_lenient_json": f"{_F} select docid, pos, case when docid % 3 < 2 then pos end as found from fields where k = 0",
    "parse_verdicts": f"""{_F}, x as (select docid, pos as ord, pos % 7 as id, pos % 4 as kind, pos % 5 > 0 as ok, score from fields where k = 0), y as (select *, ok and kind < 3 and not (kind = 1 and id > 4) as good from x)
select docid, ord, case when good then ['accept', 'correct', 'reject'][kind + 1] else 'accept' end as verdict, case when ok and id < 5 then id::varchar else '' end as ids, case when good then score else 0.5::double end as confidence from y""",
    "merge_pages": f"""{_F}, p as (select docid, fieldtype, page, string_agg(pos, ',' order by pos) as texts, count(*) > 1 as listed from fields where k = 0 group by all)
select docid, fieldtype, case when bool_or(listed) then string_agg(texts, ',' order by page) else arg_min(texts, page) end as texts from p group by all""",
    "script_rules": f"""with {v.WORDS}, rules(cluster, fieldtype, label, pattern, reach) as (values {', '.join(map(str, RULES))})
select distinct w.docid, w.page, w.word_id, fieldtype, 0.9::double as score from words w join words x on w.docid = x.docid and w.page = x.page join documents on doc_id = w.docid join rules r on r.cluster = lang and lower(x.text) = r.label
where w.word_id between x.word_id + 1 and x.word_id + reach and regexp_matches(w.text, pattern)""",
    "resumable_batch": f"{_F} select p_partkey as docid from part where not exists (select 1 from fields where docid = p_partkey and k = 0 and score > 0.95::double)",
}
