"""Queries of evaluation, of passes over predictions, and of what answers and files parse to."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import catalog
from pagefold.functions import geometry as g
from pagefold.operators import analysis, evaluate, joins, providers, refine, rows
from pagefold.operators import align as al
from pagefold.plans import analyses
from pagefold.plans.geometric import REGIONS, regions
from pagefold.sources import parsing
from pagefold.sources import views as v

TYPES = sorted(catalog.KILE + catalog.LIR)
FIELD = ["docid", "fieldtype", "page", "k", "pos", "score", "li", "l", "t", "r", "b"]


def _typed(s, d):
    """Fields under the catalog's types."""
    return v.fields(s, d).withColumn("fieldtype", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("pos") * 7 % len(TYPES) + 1).cast("int")))


_TYPED = f"with {v.FIELDS}, typed as (select * replace ([{', '.join(repr(t) for t in TYPES)}][pos * 7 % {len(TYPES)} + 1] as fieldtype) from fields)"


def _gold(s, d):
    row = F.when(F.col("ord") % 3 == 2, F.col("ord"))
    return regions(s, d).select("docid", "page", F.col("label").alias("fieldtype"), F.col("ord").cast("long").alias("pos"), row.alias("li"), "l", "t", "r", "b")


def _moved(s, d):
    """The gold boxes, every other one shifted so that it may hold other characters."""
    return _gold(s, d).withColumn("l", F.col("l") + F.when(F.col("pos") % 2 == 0, 0.002).otherwise(0.0)).withColumn("score", F.col("pos") / 8)


def _run(s, d):
    docs = v.read(s, d, "documents").select(F.col("doc_id").alias("docid"))
    out = evaluate.run(_moved(s, d), _gold(s, d), v.words(s, d), docs)
    return out.select("task", *(F.round(c, 6).alias(c) for c in ("ap", "precision", "recall", "f1")), "n_gold", "n_predicted", "hits", "n_docs", "n_missing")


_CHARS = f"""with {v.WORDS}, {REGIONS}, chars as (select docid, page, word_id * 1000 + i as c, "left" + (i + 0.5::double) / length(text) * ("right" - "left") as x, (top + bottom) / 2 as y from (select *, unnest(range(length(text))) as i from words)),
gold as (select docid, page, case when ord % 3 = 2 then 'lir' else 'kile' end as task, label as fieldtype, cast(ord as bigint) as pos, l, t, r, b from regions), moved as (select * replace (l + case when pos % 2 = 0 then 0.002::double else 0 end as l), pos / 8 as score from gold),
hg as (select g.docid, g.page, fieldtype, pos, list(c order by c) as cs from gold g join chars c on g.docid = c.docid and g.page = c.page and x between l and r and y between t and b group by all),
hp as (select m.docid, m.page, fieldtype, pos, any_value(score) as score, list(c order by c) as cs from moved m join chars c on m.docid = c.docid and m.page = c.page and x between l and r and y between t and b group by all),
ng as (select *, row_number() over (partition by docid, page, fieldtype, cs order by pos) as nth from hg), np as (select *, row_number() over (partition by docid, page, fieldtype, cs order by score desc, pos) as nth from hp),
hits as (select np.docid, np.page, np.fieldtype, np.pos from np join ng on np.docid = ng.docid and np.page = ng.page and np.fieldtype = ng.fieldtype and np.cs = ng.cs and np.nth = ng.nth),
told as (select m.*, h.pos is not null as hit from moved m left join hits h on m.docid = h.docid and m.page = h.page and m.fieldtype = h.fieldtype and m.pos = h.pos)"""


def _docs(s, d):
    return v.read(s, d, "part").select(F.col("p_partkey").alias("docid"), (F.col("p_size") % 5).alias("cluster")).where("docid % 9 <> 0")


def _prior(s):
    return s.createDataFrame([(c, t) for c in range(4) for t in ("AF", "NO", "RF")[: c + 1]], "cluster int, fieldtype string")


_PRIOR = "prior as (select cluster, unnest(['AF', 'NO', 'RF'][:cluster + 1]) as fieldtype from range(4) t(cluster)), docs as (select p_partkey as docid, p_size % 5 as cluster from part where p_partkey % 9 <> 0)"


def _base(s, d):
    return v.fields(s, d).where("k = 0 and score < 0.6").select(FIELD)


def _new(s, d):
    return v.fields(s, d).where("k = 1").select(FIELD)


_RECALL = f"""with {v.FIELDS}, {_PRIOR}, base as (select * from fields where k = 0 and score < 0.6), lacking as (select docid, p.fieldtype from docs join prior p using (cluster) where not exists (select 1 from base b where b.docid = docs.docid and b.fieldtype = p.fieldtype and b.li is null)),
new as (select * from fields f where k = 1 and (docid, fieldtype) in (select docid, fieldtype from lacking) and not exists (select 1 from base b where b.docid = f.docid and b.fieldtype = f.fieldtype and b.page = f.page and greatest(least(f.r, b.r) - greatest(f.l, b.l), 0) * greatest(least(f.b, b.b) - greatest(f.t, b.t), 0)
  / ((f.r - f.l) * (f.b - f.t) + (b.r - b.l) * (b.b - b.t) - greatest(least(f.r, b.r) - greatest(f.l, b.l), 0) * greatest(least(f.b, b.b) - greatest(f.t, b.t), 0)) > 0.01)),
kept as (select * from (select *, row_number() over (partition by docid, fieldtype order by score desc, page, pos) as rank from new) where fieldtype = 'RF' or rank = 1)"""


def _amounts(s, d):
    return analyses._amounts(s, d).withColumn("k", F.lit(0))


def _reprompt(s, d):
    """Every other failed page is asked again with amounts that balance."""
    old = _amounts(s, d)
    bad = analysis.calc_check(old).where("off")
    value = {"amount_total_net": "100.00", "amount_total_tax": "21.00"}
    text = F.when(F.col("fieldtype") == "amount_total_gross", F.when(F.col("docid") % 2 == 0, "121.00").otherwise("150.00"))
    for t, x in value.items():
        text = F.when(F.col("fieldtype") == t, x).otherwise(text)
    new = bad.select("docid", "page", F.explode(F.array(*map(F.lit, analyses.AMOUNT_TYPES))).alias("fieldtype")).select("docid", "page", "fieldtype", text.alias("text"), F.lit(1.0).alias("score"), F.lit(1).alias("k"))
    out = evaluate.replace_amounts(old, bad, new)
    return out.groupBy("docid", "page").agg(F.count("*").alias("n"), F.max("k").alias("new"))


def _triage(s, d):
    f = v.fields(s, d).where("k = 0").groupBy("docid").agg(F.sort_array(F.collect_set("fieldtype")).alias("present_fields"))
    raw = F.when(F.col("docid") % 5 == 0, "no answer").otherwise(F.to_json(F.struct("present_fields")))
    return evaluate.triage(f.select("docid", raw.alias("raw")))


def _corrections(s, d):
    item = F.struct("fieldtype", F.when(F.col("pos") % 3 == 0, "remove").otherwise("keep").alias("action"))
    c = v.fields(s, d).where("k = 1 and pos < 3").groupBy("docid").agg(F.collect_list(item).alias("corrections"))
    answers = c.select("docid", F.when(F.col("docid") % 7 == 0, "{broken").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct("corrections")), F.lit("\n```"))).alias("raw"))
    return evaluate.cross_check(v.fields(s, d).where("k = 0"), answers).select("docid", "pos")


def _responses(s, d):
    """Answers of a page's fields that name the word whose number is the field's place."""
    one = F.struct("fieldtype", F.array(F.col("pos").cast("int")).alias("word_ids"), F.when(F.col("pos") % 2 == 0, F.col("score")).alias("score"))
    pages = v.fields(s, d).where("k = 0").groupBy("docid", "page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("f")))), lambda x: x["f"]).alias("fields"))).alias("json"))
    return pages.select("docid", "page", F.when(F.col("docid") % 7 == 0, "{").otherwise(F.col("json")).alias("raw"))


def _candidates(s, d):
    item = F.concat(F.lit('{"word_ids":'), F.when(F.col("pos") % 4 == 3, '"x"').otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))), F.when(F.col("pos") % 2 == 0, F.concat(F.lit(',"score":'), F.col("score").cast("string"))).otherwise(""), F.lit(',"text":"t"}'))
    docs = v.fields(s, d).where("k = 0").groupBy("docid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    raw = F.concat(F.when(F.col("docid") % 2 == 0, "I looked and found: ").otherwise(""), F.lit('{"candidates": ['), "items", F.lit("]}"))
    return parsing.embedded_candidates(docs.select("docid", raw.alias("raw"))).select("docid", F.element_at("word_ids", 1).cast("long").alias("pos"), "text", "score")


def _scripts(s, d):
    ids = F.when(F.col("pos") % 5 == 4, '["a"]').when(F.col("pos") % 5 == 3, "[1.5]").otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    item = F.when(F.col("pos") % 11 == 10, "7").otherwise(F.concat(F.lit('{"fieldtype":"'), "fieldtype", F.lit('","word_ids":'), ids, F.lit(',"line_item_id":3}')))
    docs = v.fields(s, d).where("k = 0").groupBy("docid").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]), ","), F.lit("]")).alias("raw"))
    return parsing.script_output(docs, ["AF", "RF"]).select("docid", "fieldtype", F.element_at("word_ids", 1).cast("long").alias("pos"))


def _structure(s, d):
    p = v.read(s, d, "part").select(F.col("p_partkey").alias("docid"))
    raw = F.when(F.col("docid") % 4 == 0, "sorry").otherwise(F.concat(F.lit('{"header_row": '), (F.col("docid") % 3).cast("string"), F.lit(', "columns": {"0": "line_item_code", "1": null, "2": "null", "3": "vendor_name", "x": "line_item_code"}}')))
    return parsing.table_structure(p.select("docid", raw.alias("raw")), catalog.LIR).select("docid", "header_row", F.array_join(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"], F.lit("-")))), ",").alias("columns"))


def _programs(s, d):
    p = v.read(s, d, "part").select(F.col("p_partkey").alias("docid"))
    body = F.lit("def extract(words):\n    results = []\n    return results")
    k = F.col("docid") % 5
    raw = F.when(k == 0, F.concat(F.lit("Here:\n```python\n"), body, F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k == 2, body).when(k == 3, "```python\ndef extract(words):\n    found = [").otherwise("")
    code = p.select("docid", parsing.code_block(raw).alias("code"))
    return code.select("docid", "code", parsing.truncated(F.col("code")).alias("cut"))


def _ocr(s, d):
    """Pages as nested OCR files: some words have no box, some a snapped one."""
    w = v.words(s, d)
    box = F.when(F.col("word_id") % 7 != 3, F.array(F.array("left", "top"), F.array("right", "bottom")))
    snapped = F.when(F.col("word_id") % 7 == 1, F.array(F.array(F.col("left") + 1, F.col("top")), F.array(F.col("right") + 1, F.col("bottom"))))
    one = F.struct(F.col("text").alias("value"), box.alias("geometry"), snapped.alias("snapped_geometry"))
    lines = w.groupBy("docid", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", one.alias("w")))), lambda x: x["w"]).alias("words"))
    blocks = F.array(F.struct(F.array(F.struct("words")).alias("lines")))
    return lines.groupBy("docid").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("page", blocks.alias("blocks")))), lambda p: F.struct(p["page"].alias("page_idx"), p["blocks"].alias("blocks"))).alias("pages"))).alias("raw"))


def _placed(s, d):
    return v.fields(s, d).where("k = 0").select("docid", "page", "fieldtype", F.col("pos").alias("ord"), F.concat(F.lit("t"), F.col("pos").cast("string")).alias("text"), *((F.col(c) / 64).alias(n) for c, n in zip("ltrb", g.SIDES, strict=True)))


def _chat(s, d):
    images = v.read(s, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("docid"), F.concat(F.lit("page-"), F.col("p_partkey").cast("string")).alias("image"))
    return parsing.chat_rows(_placed(s, d), images, "Find the fields.", "You read invoices.").select("docid", "answer", F.get_json_object("json", "$.image").alias("image"), F.length("json").alias("n"))


def _geometry(s, d):
    box = tuple(F.col(c) / 64 for c in "ltrb")
    back = g.polygon_box(g.pixel_polygon(box, 800, 1000), 800, 1000)
    crop = g.crop_to_page((F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.5)), box, 0.2)
    return v.fields(s, d).where("k = 0").select("docid", "pos", *(F.round(back[n], 6).alias(n) for n in g.SIDES), F.round(crop["left"], 6).alias("crop_left"), F.round(crop["bottom"], 6).alias("crop_bottom"))


def _html(s, d):
    """Fields as tables of HTML, with cells left open."""
    row = F.concat(F.lit("<tr><td>"), F.col("pos").cast("string"), F.lit("</td><td> "), "fieldtype", F.lit("\n x </td><th></th></tr>"))
    f = v.fields(s, d).where("k = 0").groupBy("docid").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))
    return parsing.table_cells(f)


def _stripped(s, d):
    w = v.mixed(s, d).withColumn("span_id", F.col("word_id") - F.col("word_id") % 29)
    held = w.groupBy("docid", "page", "span_id").agg(F.sort_array(F.collect_list("word_id")).alias("word_ids"))
    ws = refine.span_words(held, v.mixed(s, d))
    return ws.select("docid", "page", "span_id", F.size(refine.strip_labels(F.col("ws"), refine.LABELS["amount"])).alias("n"))


def _entries(s, d):
    f = v.fields(s, d).where("k = 0").groupBy("docid", "fieldtype").agg(F.sort_array(F.collect_list(F.concat(F.lit(" "), F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("pos").cast("string"))))).alias("texts"))
    maps = f.groupBy("docid").agg(F.map_from_entries(F.collect_list(F.struct("fieldtype", "texts"))).alias("m"))
    return maps.select("docid", F.explode(parsing.normal_entries(F.col("m"), ["AF", "RF"])).alias("fieldtype", "texts")).select("docid", "fieldtype", F.array_join("texts", ",").alias("texts"))


def _hints(s, d):
    f = v.fields(s, d).where("k = 0").select("docid", "page", "fieldtype", F.concat(F.lit("x"), F.col("pos").cast("string")).alias("text"), F.col("pos").alias("start"), F.when(F.col("pos") % 2 == 0, 1.0).otherwise(0.7).alias("score"))
    return al.hints(f)


def _gold_json(s, d):
    f = v.fields(s, d).where("k = 0").select("docid", F.col("pos").alias("ord"), "fieldtype", F.lit("x").alias("text"), F.col("li").alias("line_item_id"))
    return parsing.gold_json(f.where("line_item_id is null")).select("docid", "json")


def _messages(s, d):
    f = v.fields(s, d).where("k = 0").select("docid", F.col("pos").alias("n"), "fieldtype", F.concat(F.lit("page "), F.col("page").cast("string")).alias("prompt"), F.col("fieldtype").alias("answer"))
    return providers.few_shot_messages(f)


def _text_answers(s, d):
    one = F.struct("fieldtype", F.when(F.col("pos") % 3 == 0, " ").otherwise(F.concat(F.lit("t"), F.col("pos").cast("string"))).alias("text"))
    pages = v.fields(s, d).where("k = 0").groupBy("docid", "page").agg(F.to_json(F.struct(F.collect_list(one).alias("fields"))).alias("raw"))
    return parsing.text_answers(pages, ["AF", "RF"]).select("docid", "page", "fieldtype", "text", "score")


def _regions_of_values(s, d):
    values = v.fields(s, d).where("k = 0 and page = 0 and docid % 20 = 0").select("docid", "page", F.col("pos").alias("vid"), F.lit("acme corp").alias("value"))
    found = v.fields(s, d).where("k = 1 and page = 0").select("docid", "page", F.col("pos").alias("ord"), F.when(F.col("pos") % 2 == 0, "to acme corp ltd").otherwise("zzz").alias("text"))
    return al.fuzzy_region(values, found).select("docid", "page", "vid", "ord", "ratio")


def _layout_prompts(s, d):
    """A page's prompt: its rows of words in the template."""
    return providers.page_prompts(rows.layout(rows.row_groups(v.words(s, d)))).select("docid", "page", F.length("prompt").cast("long").alias("n"))


def _cells(s, d):
    """Regions as the cells of a table of two columns a page."""
    r = regions(s, d)
    cells = r.select("docid", "page", F.lit(0).alias("table_id"), F.floor(F.col("ord") / 2).cast("int").alias("row"), (F.col("ord") % 2).alias("col"), "label", "l", "t", "r", "b").withColumnRenamed("label", "text")
    types = F.posexplode(F.array(F.lit("line_item_code"), F.lit("line_item_quantity"))).alias("col", "fieldtype")
    columns = cells.select("docid", "page", "table_id").distinct().select("docid", "page", "table_id", types)
    return joins.cells_on_words(cells, columns, v.words(s, d)).select("docid", "page", "fieldtype", F.col("line_item_id").cast("long"), "text", "left", "right")


QUERIES = {
    "cells_on_words": _cells,
    "run_eval": _run,
    "recall_chain": lambda s, d: evaluate.recall(_base(s, d), _docs(s, d), _prior(s), _new(s, d), ["RF"]).select("docid", "fieldtype", "page", "k", "pos", F.round("score", 6).alias("score")),
    "recall_counts": lambda s, d: evaluate.recall_counts(_base(s, d), _docs(s, d), _prior(s), _new(s, d), v.fields(s, d).select("docid", "page").distinct(), multi=["RF"]),
    "reprompt_replace": _reprompt,
    "triage": _triage,
    "cross_check": _corrections,
    "add_absent": lambda s, d: evaluate.add_absent(_typed(s, d).where("k = 0 and score < 0.6"), _typed(s, d).where("k = 1")).select("docid", "fieldtype", "page", "k", "pos"),
    "docid_gate": lambda s, d: evaluate.only_docids(v.fields(s, d).where("k = 0"), v.read(s, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("docid")), first=250).select("docid", "pos"),
    "targeted_fields": lambda s, d: evaluate.targeted(_typed(s, d)).select("docid", "fieldtype", "k", "pos"),
    "strong_fields": lambda s, d: evaluate.strong(_typed(s, d)).select("docid", "fieldtype", "k", "pos"),
    "catalog": lambda s, d: s.createDataFrame(catalog.rows(), "fieldtype string, task string, multi boolean, family string, targeted boolean, weak boolean"),
    "parse_recall_json": lambda s, d: parsing.recall_answers(_responses(s, d), v.words(s, d), ["AF", "RF"]).select("docid", "page", "fieldtype", F.round("score", 6).alias("score"), "left", "bottom"),
    "parse_text_json": _text_answers,
    "parse_candidates": _candidates,
    "parse_script_output": _scripts,
    "parse_table_structure": _structure,
    "parse_programs": _programs,
    "normal_entries": _entries,
    "oracle_hints": _hints,
    "gold_json": _gold_json,
    "few_shot_messages": _messages,
    "html_cells": _html,
    "ocr_words": lambda s, d: parsing.ocr_words(_ocr(s, d)).select("docid", "page", "word_id", "text", "left", "top"),
    "strip_snapped": lambda s, d: parsing.ocr_words(parsing.without_snapped(_ocr(s, d))).select("docid", "page", "word_id", "left"),
    "page_training_rows": lambda s, d: parsing.page_rows(v.read(s, d, "part").select(F.col("p_partkey").alias("docid"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page")), _placed(s, d)),
    "chat_training_rows": _chat,
    "box_geometry": _geometry,
    "strip_labels": _stripped,
    "fuzzy_region": _regions_of_values,
    "page_prompts": _layout_prompts,
}
_F = f"with {v.FIELDS}"
_L = "case when {c} then {x} else {y} end"
_BOXES = "'[' || cast(trunc(l / 64 * 1000) as int) || ',' || cast(trunc(t / 64 * 1000) as int) || ',' || cast(trunc(r / 64 * 1000) as int) || ',' || cast(trunc(b / 64 * 1000) as int) || ']'"
_ROUND = "'[' || cast(round_even(l / 64 * 1000, 0) as int) || ',' || cast(round_even(t / 64 * 1000, 0) as int) || ',' || cast(round_even(r / 64 * 1000, 0) as int) || ',' || cast(round_even(b / 64 * 1000, 0) as int) || ']'"
_OCR = f"""with {v.WORDS}, x as (select docid, page, word_id as old, text, "left" + case when word_id % 7 = 1 then {{shift}} else 0 end as "left", top from words where word_id % 7 <> 3 or word_id % 7 = 1)"""
SQL = {
    "character_match": f"{_CHARS} select docid, hit, count(*) as n from (select m.docid, m.page, m.fieldtype, m.pos, m.hit from told m) group by 1, 2",
    "parse_broken_json": f"with {v.FIELDS} select distinct docid, page, 2 as n from fields where k = 0",
    "cells_on_words": f"""with {v.WORDS}, {REGIONS} select x.docid, x.page, case x.ord % 2 when 0 then 'line_item_code' else 'line_item_quantity' end as fieldtype, cast(x.page * 10000 + x.ord // 2 as bigint) as line_item_id, string_agg(w.text, ' ' order by w.word_id) as text, min(w."left") as "left", max(w."right") as "right"
from regions x join words w on w.docid = x.docid and w.page = x.page and (w."left" + w."right") / 2 between x.l and x.r and (w.top + w.bottom) / 2 between x.t and x.b where x.ord >= 2 group by x.docid, x.page, x.ord""",
    "run_eval": f"""{_CHARS}, ranked as (select *, row_number() over w as rank, sum(hit::int) over (partition by task order by score desc, docid, page, fieldtype, pos rows unbounded preceding) as so_far from told window w as (partition by task order by score desc, docid, page, fieldtype, pos)),
n as (select task, count(*) as n_gold from gold group by 1), p as (select task, count(*) as n_predicted, cast(count_if(hit) as bigint) as hits, count(distinct docid) as docs, coalesce(sum(so_far / rank) filter (where hit), 0) as total from ranked group by 1)
select task, round(total / n_gold, 6) as ap, round(hits / n_predicted, 6) as precision, round(hits / n_gold, 6) as recall, round(case when hits = 0 then 0 else 2 * (hits / n_predicted) * (hits / n_gold) / (hits / n_predicted + hits / n_gold) end, 6) as f1, n_gold, n_predicted, hits,
  (select count(*) from documents) as n_docs, (select count(*) from documents) - docs as n_missing from n join p using (task)""",
    "recall_chain": f"{_RECALL} select docid, fieldtype, page, k, pos, round(score, 6) as score from base union all select docid, fieldtype, page, k, pos, round(score * 0.7::double, 6) from kept",
    "recall_counts": f"""{_RECALL}, mine as (select * from docs where docid in (select docid from base)), known as (select * from mine where cluster in (select cluster from prior)), want as (select * from lacking where docid in (select docid from known))
select (select count(*) from known) as docs_with_cluster, (select count(*) from mine) - (select count(*) from known) as docs_without, (select count(distinct docid) from want) as docs_lacking, (select count(*) from want) as types_lacking,
  (select count(*) from (select distinct docid, page from fields) where docid in (select docid from want)) as pages_asked, (select count(*) from kept where docid in (select docid from want)) as added""",
    "triage": f"{_F} select distinct docid, fieldtype from fields where k = 0 and docid % 5 <> 0 union all select docid, unnest([{', '.join(repr(t) for t in TYPES)}]) from (select distinct docid from fields where k = 0 and docid % 5 = 0)",
    "cross_check": f"{_F} select docid, pos from fields a where k = 0 and not exists (select 1 from fields c where c.k = 1 and c.pos < 3 and c.pos % 3 = 0 and c.docid % 7 <> 0 and c.docid = a.docid and c.fieldtype = a.fieldtype)",
    "add_absent": f"""{_TYPED}, base as (select * from typed where k = 0 and score < 0.6), new as (select *, row_number() over (partition by docid, fieldtype order by score desc, page, pos) as rank from typed f where k = 1 and score >= 0.85 and fieldtype not in {(*catalog.WEAK, *catalog.LIR)}
  and not exists (select 1 from base b where b.docid = f.docid and b.fieldtype = f.fieldtype and b.li is null)) select docid, fieldtype, page, k, pos from base union all select docid, fieldtype, page, k, pos from new where rank = 1""",
    "docid_gate": f"{_F}, f as (select * from fields where k = 0 and docid in (select p_partkey from part where p_size < 20)) select docid, pos from f where docid in (select distinct docid from f order by docid limit 250)",
    "targeted_fields": f"{_TYPED} select docid, fieldtype, k, pos from typed where fieldtype in {tuple(catalog.TARGETED)}",
    "strong_fields": f"{_TYPED} select docid, fieldtype, k, pos from typed where fieldtype not in {(*catalog.WEAK, *catalog.LIR)}",
    "parse_recall_json": f"""with {v.WORDS}, {v.FIELDS} select f.docid, f.page, fieldtype, round(case when pos % 2 = 0 then score else 0.7::double end * 0.7::double, 6) as score, w."left" as "left", w.bottom as bottom from fields f join words w on w.docid = f.docid and w.page = f.page and w.word_id = f.pos where k = 0 and f.docid % 7 <> 0 and fieldtype in ('AF', 'RF')""",
    "parse_text_json": f"{_F} select docid, page, fieldtype, concat('t', pos) as text, 0.8::double as score from fields where k = 0 and pos % 3 <> 0 and fieldtype in ('AF', 'RF')",
    "parse_candidates": f"{_F} select docid, pos, 't' as text, case when pos % 2 = 0 then score else 0.5::double end as score from fields where k = 0 and pos % 4 <> 3",
    "parse_script_output": f"{_F} select docid, fieldtype, pos from fields where k = 0 and pos % 5 < 3 and pos % 11 <> 10 and fieldtype in ('AF', 'RF')",
    "parse_table_structure": "select p_partkey as docid, case when p_partkey % 4 = 0 then 0 else cast(p_partkey % 3 as int) end as header_row, case when p_partkey % 4 = 0 then '' else '0=line_item_code,1=-,2=-' end as columns from part",
    "parse_programs": """select p_partkey as docid, case when p_partkey % 5 < 3 then 'def extract(words):' || chr(10) || '    results = []' || chr(10) || '    return results' when p_partkey % 5 = 3 then 'def extract(words):' || chr(10) || '    found = [' else '' end as code, p_partkey % 5 > 2 as cut from part""",
    "normal_entries": f"{_F} select docid, fieldtype, string_agg(pos, ',' order by pos::varchar) as texts from fields where k = 0 and pos % 3 <> 0 and fieldtype in ('AF', 'RF') group by 1, 2",
    "oracle_hints": f"{_F} select docid, page, string_agg(concat(fieldtype, ': x', pos), chr(10) order by fieldtype, pos) as hint from fields where k = 0 and pos % 2 = 0 group by 1, 2",
    "gold_json": f"""{_F} select docid, '{{"fields":[' || string_agg('{{"fieldtype":"' || fieldtype || '","text":"x"}}', ',' order by pos) || '],"line_items":[]}}' as json from fields where k = 0 and li is null group by 1""",
    "few_shot_messages": f"""{_F} select docid, '[' || string_agg('{{"role":"user","content":"page ' || page || '"}},{{"role":"assistant","content":"' || fieldtype || '"}}', ',' order by pos) || ']' as messages from fields where k = 0 group by 1""",
    "html_cells": f"{_F}, n as (select docid, cast(row_number() over (partition by docid order by pos) - 1 as int) as row, pos, fieldtype from fields where k = 0) select docid, row, 0 as col, pos::varchar as text from n union all select docid, row, 1, fieldtype || ' x' from n union all select docid, row, 2, '' from n",
    "ocr_words": f"""{_OCR.format(shift=1)} select docid, page, cast(row_number() over (partition by docid, page order by old) - 1 as int) as word_id, text, "left", top from x""",
    "strip_snapped": f"""{_OCR.format(shift=0)} select docid, page, cast(row_number() over (partition by docid, page order by old) - 1 as int) as word_id, "left" from x""",
    "page_training_rows": f"""{_F}, e as (select docid, page, '"' || fieldtype || '":' || case when count(*) = 1 then any_value({_BOXES}) else '[' || string_agg({_BOXES}, ',' order by pos) || ']' end as entry from fields where k = 0 group by docid, page, fieldtype),
j as (select docid, page, '{{' || string_agg(entry, ',' order by entry) || '}}' as json from e group by 1, 2) select p_partkey as docid, cast(n as int) as page, coalesce(json, '{{}}') as json from part cross join range(2) t(n) left join j on j.docid = p_partkey and j.page = n""",
    "chat_training_rows": f"""{_F}, o as (select docid, fieldtype, min(pos) as first, arg_max('{{"text":"t' || pos || '","bbox_2d":' || {_ROUND} || '}}', pos) as value from fields where k = 0 and page = 0 group by 1, 2), a as (select docid, '{{' || string_agg('"' || fieldtype || '":' || value, ',' order by first) || '}}' as answer from o group by 1)
select docid, answer, 'page-' || docid as image, cast(length('{{"conversations":[{{"from":"human","value":"Find the fields."}},{{"from":"gpt","value":"' || replace(answer, '"', '\\"') || '"}}],"system":"You read invoices.","image":"page-' || docid || '"}}') as int) as n from a where docid % 3 <> 0 and docid in (select p_partkey from part)""",
    "box_geometry": f"""{_F} select docid, pos, round(l / 64, 6) as "left", round(t / 64, 6) as top, round(r / 64, 6) as "right", round(b / 64, 6) as bottom, case when (r - l) / 64 >= 0.2 and (b - t) / 64 >= 0.2 then round(least(greatest(l / 64 + 0.25 * (r - l) / 64, 0), 1), 6) end as crop_left,
  case when (r - l) / 64 >= 0.2 and (b - t) / 64 >= 0.2 then round(least(greatest(t / 64 + 1.5 * (b - t) / 64, 0), 1), 6) end as crop_bottom from fields where k = 0""",
    "strip_labels": f"""with {v.WORDS}, {v.MIXED}, x as (select docid, page, word_id - word_id % 29 as span_id, word_id, lower(trim(text)) in {tuple(refine.LABELS["amount"])} as lab from mixed), y as (select *, min(case when not lab then word_id end) over (partition by docid, page, span_id) as begins from x)
select docid, page, span_id, cast(count_if(coalesce(word_id >= begins, false)) as int) as n from y group by 1, 2, 3""",
}
