"""Queries of aggregates, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import text
from pagefold.operators import analysis as a
from pagefold.operators import joins
from pagefold.plans.geometric import regions
from pagefold.sources import views as v

TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SHAPED = "shaped as (select o_custkey % 400 as cluster, o_orderkey as docid, o_orderpriority as fieldtype, (o_orderkey % 7) / 100.0::double as x, (o_custkey % 5) / 100.0::double as y, concat(o_orderstatus, o_orderkey % 3) as text from orders)"


def _orders(s, d):
    return v.read(s, d, "orders")


def _docs(s, d):
    return v.annotated(s, d).select("docid", "cluster").distinct()


def _shaped(s, d):
    return _orders(s, d).select((F.col("o_custkey") % 400).alias("cluster"), F.col("o_orderkey").alias("docid"), F.col("o_orderpriority").alias("fieldtype"), ((F.col("o_orderkey") % 7) / 100.0).alias("x"), ((F.col("o_custkey") % 5) / 100.0).alias("y"), F.concat("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("text"))


def _knn(s, d, k, vector=None, weighted=None):
    """Every twentieth vector against all the others."""
    e, vector = v.read(s, d, "embeddings"), F.col("embedding") if vector is None else vector
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), (vector if weighted is None else weighted).alias("vector"))
    return a.nearest(queries, e.select(F.col("vec_id").alias("id"), vector.alias("vector"), "label"), k)


def _hybrid(s, d):
    """The vector and which of its first eight numbers are positive, seven to three: the product of both in one, weighted on the query's side."""
    signs = F.transform(F.slice("embedding", 1, 8), lambda y: F.when(y > 0, 1.0).otherwise(0.0))
    whole = lambda w1, w2: F.concat(F.transform("embedding", lambda y: y.cast("double") * w1), F.transform(signs, lambda y: y * w2))
    return _knn(s, d, 3, whole(1.0, 1.0), whole(0.7, 0.3 / 8)).select("query", "id", "sim", "rank")


def _tokens(s, d, table, key, name):
    docs = v.read(s, d, table).select(F.col(key).alias(name), F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9]+", -1)).alias("token"))
    return docs.where(F.length("token") >= 2).distinct()


def _jaccard(s, d, k=1):
    return a.jaccard(_tokens(s, d, "benchmark", "item_id", "query"), _tokens(s, d, "documents", "doc_id", "id"), k)


def _scored(s, d):
    docs, labels = v.read(s, d, "documents"), v.read(s, d, "labels")
    return docs.join(labels, "doc_id").select("lang", (F.col("n_chars") % 1000 / 1000).alias("score"), F.col("doc_id").alias("ord"), (F.col("quality") == 1).alias("hit"))


def _ap(s, d):
    x = _scored(s, d)
    return a.average_precision(x, x.groupBy("lang").agg(F.count("*").alias("n_gold")), ["lang"])


_CENTS = "concat(cast(cast(floor(floor({v} * 100) / 100) as bigint) as string), '{sign}', lpad(cast(cast(floor({v} * 100) as bigint) % 100 as string), 2, '0'))"
AMOUNTS = f"""select l_orderkey as docid, l_linenumber as page, fieldtype, case fieldtype when 'amount_total_net' then {_CENTS.format(v='l_extendedprice', sign=',')} when 'amount_total_tax' then {_CENTS.format(v='(l_extendedprice * l_tax)', sign='.')}
  else {_CENTS.format(v='(l_extendedprice * (1 + l_tax) * (1 + l_partkey % 7 * 0.0625))', sign='.')} end as text, l_partkey % 10 + l_suppkey % 7 * 10 + l_quantity * 100 + l_extendedprice as score
  from {{lineitem}}"""
AMOUNT_TYPES = ["amount_total_net", "amount_total_tax", "amount_total_gross"]
AMOUNTS_SQL = "amounts as (" + AMOUNTS.format(lineitem=f"(select *, unnest({AMOUNT_TYPES}) as fieldtype from lineitem)").replace("as string)", "as varchar)") + ")"


def _amounts(s, d):
    return s.sql(AMOUNTS, lineitem=v.read(s, d, "lineitem").withColumn("fieldtype", F.explode(F.array(*map(F.lit, AMOUNT_TYPES)))))


def _checks(s, d):
    return a.calc_check(_amounts(s, d))


def _cells(s, d):
    f = v.fields(s, d)
    cells = f.where("k = 0").select("docid", "page", F.lit(1).alias("table_id"), F.col("pos").alias("row"), (F.col("pos") % 3).alias("col"), F.col("fieldtype").alias("text"))
    types = F.posexplode(F.array(F.lit("line_item_code"), F.lit("line_item_quantity"), F.lit(None).cast("string"))).alias("col", "fieldtype")
    columns = cells.select("docid", "page", "table_id").distinct().select("docid", "page", "table_id", types)
    return joins.cells_to_fields(cells, columns, 1).select("docid", "page", "fieldtype", "line_item_id", "score")


VERDICTS = """select docid, fieldtype, pos, case pos % 3 when 0 then 'reject' when 1 then 'correct' else 'accept' end as verdict, array(cast(pos as int)) as ids, score as confidence from {fields} where k = 0"""


def _verdicts(s, d):
    f = v.fields(s, d)
    fields = f.where("k = 0").select("docid", "fieldtype", "pos", F.array(F.lit(0)).alias("word_ids"))
    return a.apply_verdicts(fields, s.sql(VERDICTS, fields=f).where("pos % 5 <> 0")).select("docid", "fieldtype", "pos", F.array_join("word_ids", ",").alias("ids"))


def _augment(s, d):
    f = v.fields(s, d)
    cols = ["docid", "fieldtype", "page", "pos", "k", "score"]
    return a.augment(f.where("k = 0 and score < 0.7").select(cols), f.where("k = 1").select(cols), ["RF"])


def _recall(s, d):
    f = v.fields(s, d)
    ids = F.array((F.col("pos") % 10).cast("int"), (F.col("pos") % 4).cast("int"))
    return a.script_recall(f.where("k = 0").select("docid", "fieldtype", ids.alias("ids")), f.where("k = 1 and score > 0.9").select("docid", "fieldtype", ids.alias("ids")))


def _misses(s, d):
    f = v.fields(s, d)
    return a.miss_reason(f.select("docid", "fieldtype", (F.col("l") > 0).alias("triaged"), (F.col("pos") % 2).alias("n_candidates"), (F.col("score") > 0.98).alias("removed"), F.when(F.col("k") < 3, "reject").alias("verdict"), (F.col("score") + 0.05).alias("confidence")))


def _rerank(s, d, soft):
    f = v.fields(s, d).withColumn("p", F.when(F.col("pos") % 4 != 0, F.col("pos") % 10 / 10))
    return (a.soft_rerank(f) if soft else a.rerank(f)).select("docid", "k", "pos", F.round("score", 6).alias("score"))


def _char_match(s, d):
    gold = regions(s, d).select("docid", "page", F.col("label").alias("fieldtype"), F.col("ord").alias("pos"), "l", "t", "r", "b")
    moved = gold.withColumn("l", F.col("l") + F.when(F.col("pos") % 2 == 0, 0.002).otherwise(0.0)).withColumn("score", F.col("pos") / 8)
    return a.character_match(moved, gold, v.words(s, d)).groupBy("docid", "hit").agg(F.count("*").alias("n"))


QUERIES = {
    "cluster_prior": lambda s, d: a.cluster_prior(v.annotated(s, d), _docs(s, d), 0.2),
    "missing_types": lambda s, d: joins.missing_types(_docs(s, d), a.cluster_prior(v.annotated(s, d), _docs(s, d), 0.2).drop("share"), v.annotated(s, d)),
    "cluster_tightness": lambda s, d: a.tightness(_shaped(s, d)).select("cluster", F.round("presence", 6).alias("presence"), F.round("spread", 6).alias("spread"), F.round("shape", 6).alias("shape"), "verdict"),
    "coverage_hist": lambda s, d: a.coverage(_shaped(s, d).select("docid", (F.col("cluster") * 2).alias("cluster")), a.tightness(_shaped(s, d)), _shaped(s, d)),
    "entity_vector": lambda s, d: a.entity_vector(_orders(s, d).select(F.col("o_custkey").alias("docid"), F.col("o_orderpriority").alias("fieldtype")), TYPES).select("docid", F.array_join("vector", "").alias("vector")),
    "knn_top1": lambda s, d: _knn(s, d, 1).select("query", "id", "sim"),
    "knn_vote": lambda s, d: a.majority(_knn(s, d, 5)),
    "hybrid_knn": _hybrid,
    "cluster_accuracy": lambda s, d: a.accuracy(_knn(s, d, 1).join(v.read(s, d, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").alias("truth")), "query")).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "mean", "p25", "median", "p75", "high", "low"))),
    "jaccard_top1": lambda s, d: _jaccard(s, d).select("query", "id", F.round("jaccard", 6).alias("jaccard")),
    "jaccard_buckets": lambda s, d: a.buckets(_jaccard(s, d).withColumn("jaccard", F.round("jaccard", 6)), "jaccard").select(*(F.round(c, 6).alias(c) for c in ("median", "mean", "least", "most")), "under_3", "under_5", "under_7", "above"),
    "fewshot_lookup": lambda s, d: joins.few_shot(_docs(s, d), v.annotated(s, d), 2, _docs(s, d).where("docid % 10 = 0").withColumn("cluster", F.lit(3))),
    "field_fewshot": lambda s, d: joins.field_few_shot(v.annotated(s, d), 3),
    "no_match_docs": lambda s, d: joins.no_match(_docs(s, d), v.annotated(s, d).where("cluster % 4 <> 1")).select("docid", "cluster"),
    "average_precision": lambda s, d: _ap(s, d).select("lang", F.round("ap", 6).alias("ap")),
    "per_field_f1": lambda s, d: a.f1(_scored(s, d).groupBy("lang").agg(F.count_if(F.col("hit") & (F.col("score") > 0.4)).alias("hits"), F.count_if(F.col("score") > 0.4).alias("predicted"), F.count_if("hit").alias("gold")), "hits", "predicted", "gold").select("lang", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1"))),
    "ab_delta_gate": lambda s, d: a.gate(_ap(s, d).withColumn("ap", F.round("ap", 6)), _ap(s, d).withColumn("ap", F.round(F.lit(1) - F.col("ap"), 6)), ["lang"], "ap", ((0.5, "strong"), (0.0, "neutral"))).select("lang", F.round("delta", 5).alias("delta"), "verdict"),
    "set_f1": lambda s, d: a.set_f1(_orders(s, d).select((F.col("o_custkey")).alias("docid"), F.col("o_orderstatus").alias("fieldtype"), F.concat(F.lit(" "), "o_orderpriority").alias("text")), _orders(s, d).where("o_orderstatus <> 'P'").select((F.col("o_custkey")).alias("docid"), F.col("o_orderstatus").alias("fieldtype"), F.col("o_orderpriority").alias("text"))).select("docid", F.round("f1", 6).alias("f1")),
    "character_match": _char_match,
    "calc_verifier": lambda s, d: _checks(s, d).select("docid", "page", "gross", "net", "tax", "off"),
    "calc_demote": lambda s, d: a.demote_amounts(_amounts(s, d), _checks(s, d)).groupBy("docid", "page").agg(F.round(F.sum("score"), 3).alias("score")),
    "recall_augment": lambda s, d: _augment(s, d).select("docid", "fieldtype", "page", "pos", "k", F.round("score", 6).alias("score")),
    "verdict_apply": _verdicts,
    "classifier_rerank": lambda s, d: _rerank(s, d, False),
    "classifier_soft_rerank": lambda s, d: _rerank(s, d, True),
    "script_recall": _recall,
    "miss_classifier": _misses,
    "table_cells": _cells,
}
_DOT = "list_dot_product(q::double[], e::double[])"
_VEC = "qs as (select vec_id as query, embedding as q from embeddings where vec_id % 20 = 0), xs as (select vec_id as id, embedding as e, label from embeddings)"
_KNN = f"with {_VEC}, s as (select query, id, label, round({_DOT}, 6) as sim from qs, xs where id <> query), n as (select *, cast(row_number() over (partition by query order by sim desc, id) as int) as rank from s)"
_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2))"
_JAC = f"with q as (select item_id as query, unnest({_TOK}) as token from benchmark), x as (select doc_id as id, unnest({_TOK}) as token from documents), qn as (select query, count(*) as qn from q group by 1), xn as (select id, count(*) as xn from x group by 1), b as (select query, id, count(*) as n from q join x using (token) group by 1, 2), j as (select query, id, n / (qn + xn - n) as jaccard from b join qn using (query) join xn using (id)), t as (select distinct on (query) query, id, round(jaccard, 6) as jaccard from j order by query, jaccard desc, id)"
_PRIOR = f"{v.ANNOTATED}, docs as (select distinct docid, cluster from annotated), prior as (select cluster, fieldtype, count(distinct docid) / any_value(size) as share from annotated join (select cluster, count(distinct docid) as size from docs group by 1) using (cluster) group by 1, 2 having count(distinct docid) / any_value(size) >= 0.2)"
_TIGHT = f"""{SHAPED}, c as (select * from (select cluster, docid, row_number() over (partition by cluster order by docid) as n from shaped) where n <= 10), z as (select cluster, count(*) as docs from c group by 1 having count(*) >= 3),
r as (select s.*, docs, regexp_replace(regexp_replace(s.text, '\\p{{L}}', 'A', 'g'), '\\p{{Nd}}', '9', 'g') as sh from shaped s join c on s.cluster = c.cluster and s.docid = c.docid join z on z.cluster = s.cluster),
k as (select cluster, fieldtype, max(n) as common from (select cluster, fieldtype, sh, count(*) as n from r group by 1, 2, 3) group by 1, 2),
y as (select cluster, fieldtype, count(*) as n, any_value(docs) as docs, greatest(stddev_pop(x), stddev_pop(y)) as spread from r group by 1, 2), m as (select cluster, avg(n / docs) as presence, avg(spread) as spread, avg(common / n) as shape from y join k using (cluster, fieldtype) group by 1),
tight as (select *, case when presence >= 0.8 and spread <= 0.05 and shape >= 0.7 then 'TIGHT' when presence >= 0.5 and spread <= 0.1 then 'MEDIUM' else 'LOOSE' end as verdict from m)"""
_SC = "sc as (select lang, n_chars % 1000 / 1000 as score, doc_id as ord, quality = 1 as hit from documents join labels using (doc_id)), rk as (select *, row_number() over (partition by lang order by score desc, ord) as rank, sum(hit::int) over (partition by lang order by score desc, ord rows unbounded preceding) as hits from sc), ap as (select lang, coalesce(sum(hits / rank) filter (where hit), 0) / count(*) as ap from rk group by 1)"
SQL = {
    "cluster_prior": f"with {_PRIOR} select * from prior",
    "missing_types": f"with {_PRIOR} select d.docid, p.fieldtype from docs d join prior p using (cluster) where not exists (select 1 from annotated x where x.docid = d.docid and x.fieldtype = p.fieldtype)",
    "cluster_tightness": f"with {_TIGHT} select cluster, round(presence, 6) as presence, round(spread, 6) as spread, round(shape, 6) as shape, verdict from tight",
    "coverage_hist": f"with {_TIGHT}, v as (select s.docid, s.cluster * 2 as cluster from shaped s) select case when v.cluster not in (select cluster from shaped) then 'NO_MATCH' else coalesce(t.verdict, 'UNANALYZABLE') end as verdict, count(*) as n from v left join tight t using (cluster) group by 1",
    "entity_vector": f"select o_custkey as docid, concat({', '.join(f'''max((o_orderpriority = '{x}')::int)''' for x in TYPES)}) as vector from orders group by 1",
    "knn_top1": f"{_KNN} select query, id, sim from n where rank = 1",
    "knn_vote": f"{_KNN}, c as (select query, label, count(*) as n, min(rank) as best from n where rank <= 5 group by 1, 2) select distinct on (query) query, label from c order by query, n desc, best",
    "hybrid_knn": f"with {_VEC}, s as (select query, id, round(0.7::double * {_DOT} + 0.3::double * len(list_filter(range(1, 9), lambda i: q[i] > 0 and e[i] > 0)) / 8, 6) as sim from qs, xs where id <> query), n as (select *, cast(row_number() over (partition by query order by sim desc, id) as int) as rank from s) select * from n where rank <= 3",
    "cluster_accuracy": f"{_KNN}, p as (select sim, n.label = m.label as ok from n join embeddings m on n.query = m.vec_id where rank = 1) select round(avg(ok::int), 6) as accuracy, round(avg(sim), 6) as mean, round(quantile_cont(sim, 0.25), 6) as p25, round(quantile_cont(sim, 0.5), 6) as median, round(quantile_cont(sim, 0.75), 6) as p75, round(avg((sim > 0.8)::int), 6) as high, round(avg((sim < 0.6)::int), 6) as low from p",
    "jaccard_top1": f"{_JAC} select * from t",
    "jaccard_buckets": f"{_JAC} select round(quantile_cont(jaccard, 0.5), 6) as median, round(avg(jaccard), 6) as mean, round(min(jaccard), 6) as least, round(max(jaccard), 6) as most, count(*) filter (jaccard < 0.3) as under_3, count(*) filter (jaccard >= 0.3 and jaccard < 0.5) as under_5, count(*) filter (jaccard >= 0.5 and jaccard < 0.7) as under_7, count(*) filter (jaccard >= 0.7) as above from t",
    "fewshot_lookup": f"with {v.ANNOTATED}, docs as (select docid, case when docid % 10 = 0 then 3 else any_value(cluster) end as cluster from annotated group by 1), f as (select * from (select cluster, docid as example, cast(row_number() over (partition by cluster order by ord) as int) as n from annotated) where n <= 2) select docid, example, n from docs join f using (cluster)",
    "field_fewshot": f"with {v.ANNOTATED}, o as (select distinct on (docid, fieldtype) * from annotated order by docid, fieldtype, ord) select cluster, fieldtype, docid as example, text, n from (select *, cast(row_number() over (partition by cluster, fieldtype order by ord, docid) as int) as n from o) where n <= 3",
    "no_match_docs": f"with {v.ANNOTATED} select distinct docid, cluster from annotated where cluster % 4 = 1",
    "average_precision": f"with {_SC} select lang, round(ap, 6) as ap from ap",
    "per_field_f1": f"with {_SC}, c as (select lang, count_if(hit and score > 0.4::double) as h, count_if(score > 0.4::double) as p, count_if(hit) as g from sc group by 1), d as (select lang, h / p as precision, h / g as recall from c) select lang, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall), 6) as f1 from d",
    "ab_delta_gate": f"with {_SC}, d as (select lang, round(1 - round(ap, 6), 6) - round(ap, 6) as delta from (select lang, ap from ap)) select lang, round(delta, 5) as delta, case when delta >= 0.5 then 'strong' when delta >= 0 then 'neutral' else 'worse' end as verdict from d",
    "set_f1": "with p as (select distinct o_custkey as docid, concat(o_orderstatus, chr(31), lower(o_orderpriority)) as item from orders), q as (select distinct o_custkey as docid, concat(o_orderstatus, chr(31), lower(o_orderpriority)) as item from orders where o_orderstatus <> 'P'), c as (select docid, count(p.item) as np, count(q.item) as nq, count(case when p.item is not null and q.item is not null then 1 end) as h from p full join q using (docid, item) group by 1) select docid, round(case when h = 0 then 0 else 2 * (h / np) * (h / nq) / (h / np + h / nq) end, 6) as f1 from c",
    "calc_verifier": f"""with {AMOUNTS_SQL}, x as (select docid, page, fieldtype, score, case when contains(text, ',') then cast(replace(text, ',', '.') as double) else cast(text as double) end as value from amounts),
p as (select docid, page, arg_max(value, score) filter (fieldtype = 'amount_total_gross') as gross, arg_max(value, score) filter (fieldtype = 'amount_total_net') as net, arg_max(value, score) filter (fieldtype = 'amount_total_tax') as tax from x group by 1, 2)
select docid, page, gross, net, tax, abs(gross - (net + tax)) / greatest(abs(gross), 0.01::double) > 0.03::double as off from p""",
    "recall_augment": f"""with {v.FIELDS}, base as (select docid, fieldtype, page, pos, k, score from fields where k = 0 and score < 0.7), n as (select docid, fieldtype, page, pos, k, score, row_number() over (partition by docid, fieldtype order by score desc, page, pos) as rank from fields f where k = 1 and not exists (select 1 from base b where b.docid = f.docid and b.fieldtype = f.fieldtype))
select docid, fieldtype, page, pos, k, round(score, 6) as score from base union all select docid, fieldtype, page, pos, k, round(score * 0.7::double, 6) from n where fieldtype = 'RF' or rank = 1""",
    "verdict_apply": f"with {v.FIELDS} select docid, fieldtype, pos, case when pos % 5 <> 0 and score >= 0.6 and pos % 3 = 1 then pos::varchar else '0' end as ids from fields where k = 0 and not (pos % 5 <> 0 and score >= 0.6 and pos % 3 = 0)",
    "classifier_rerank": f"with {v.FIELDS}, x as (select *, case when pos % 4 <> 0 then pos % 10 / 10 end as p from fields) select docid, k, pos, round(score * coalesce(p, 1), 6) as score from x where p is null or p >= 0.3",
    "classifier_soft_rerank": f"with {v.FIELDS}, x as (select *, case when pos % 4 <> 0 then pos % 10 / 10 end as p from fields) select docid, k, pos, round(score * greatest(coalesce(p, 1), 0.7::double), 6) as score from x",
    "script_recall": f"with {v.FIELDS}, g as (select docid, fieldtype, [pos % 10, pos % 4] as ids from fields where k = 0), f as (select docid, fieldtype, flatten(list([pos % 10, pos % 4])) as found from fields where k = 1 and score > 0.9 group by 1, 2) select docid, cast(count_if(coalesce(list_has_any(ids, found), false)) as bigint) as hits, count(*) as n from g left join f using (docid, fieldtype) group by 1",
    "miss_classifier": f"with {v.FIELDS}, x as (select docid, fieldtype, bool_or(l > 0) as triaged, sum(pos % 2) as n, bool_or(score > 0.98) as removed, bool_and(score + 0.05::double >= 0.6) as rejected from fields group by 1, 2) select docid, fieldtype, case when not triaged then 'triage_skipped' when n = 0 then 'agent_returned_empty' when removed then 'verifier_removed' when rejected then 'span_rejected' else 'agent_returned_wrong' end as reason from x",
    "table_cells": f"with {v.FIELDS} select docid, page, case pos % 3 when 0 then 'line_item_code' else 'line_item_quantity' end as fieldtype, cast(page * 10000 + 100 + pos as bigint) as line_item_id, 0.9::double as score from fields where k = 0 and pos > 1 and pos % 3 <> 2",
}
SQL["calc_demote"] = SQL["calc_verifier"].replace("\nselect docid, page, gross", ", c as (select docid, page, gross") + ") select docid, page, round(sum(case when off then score * 0.5 else score end), 3) as score from amounts join c using (docid, page) group by 1, 2"
