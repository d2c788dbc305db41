"""Answers, OCR and predictions as text to rows. What can't be parsed gives no rows and never fails a job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.functions import geometry as g
from pagefold.operators import joins

ANSWER = "struct<fields:array<struct<fieldtype:string,text:string,word_ids:array<int>,score:double,line_item_id:int>>>"


def unfenced(raw: Column) -> Column:
    """Text without a Markdown fence around it."""
    s = F.trim(raw)
    return F.when(s.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(s, r"^```[a-z]*\n?", ""), r"\n?```$", ""))).otherwise(s)


def lenient(raw: Column) -> Column:
    """The JSON object in a text: in a fence anywhere, else from the first brace to the last, else {}."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braced != "", braced).otherwise(F.lit("{}"))


def answers(responses: DataFrame, catalog: Sequence[str], default: float = 0.8, discount: float = 1.0) -> DataFrame:
    """responses (docid, page, raw) to docid, page, ord, fieldtype, text, word_ids, score, line_item_id; types out of the catalog are dropped, a score that is missing is the default."""
    parsed = F.from_json(unfenced(F.col("raw")), ANSWER, {"mode": "PERMISSIVE"})
    rows = responses.select("docid", "page", F.posexplode(parsed["fields"]).alias("ord", "f")).select("docid", "page", "ord", "f.*")
    return rows.where(F.col("fieldtype").isin(list(catalog))).withColumn("score", F.coalesce("score", F.lit(default)) * discount)


def text_answers(responses: DataFrame, catalog: Sequence[str]) -> DataFrame:
    """answers() of those with text."""
    return answers(responses, catalog).where(F.trim("text") != "").drop("word_ids")


def grounded(responses: DataFrame, catalog: Sequence[str]) -> DataFrame:
    """{"type": {"text", "bbox_2d"} or a list of them} to docid, page, fieldtype, text, l, t, r, b, boxes by 1000; entries without a box of four are skipped."""
    entry = "array<struct<text:string,bbox_2d:array<double>>>"
    kinds = F.from_json(unfenced(F.col("raw")), "map<string,string>")
    rows = responses.select("docid", "page", F.explode(kinds).alias("fieldtype", "value"))
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    found = rows.withColumn("e", F.explode(F.from_json(listed, entry))).where((F.size("e.bbox_2d") == 4) & F.col("fieldtype").isin(list(catalog)))
    sides = [g.from_thousand(F.col("e.bbox_2d")[k]).alias(n) for k, n in enumerate("ltrb")]
    return found.select("docid", "page", "fieldtype", "e.text", *sides)


def salvaged(raw: Column) -> Column:
    """Every "key": "value" of a broken object, as a map; the last of a key counts, empty values are dropped."""
    pattern = F.lit(r'"([^"]+)"\s*:\s*"([^"]*)"')
    pairs = F.arrays_zip(F.regexp_extract_all(raw, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(raw, pattern, F.lit(2)).alias("v"))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    keys = F.array_distinct(F.regexp_extract_all(raw, pattern, F.lit(1)))
    return F.map_filter(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k)))), lambda k, v: v != "")


def verdicts(responses: DataFrame) -> DataFrame:
    """docid, ord, verdict, word_ids, confidence from responses (docid, ord, raw, valid: known ids): what does not parse, or corrects to no known id, is accept at 0.5."""
    v = F.from_json(unfenced(F.col("raw")), "struct<verdict:string,word_ids:array<int>,confidence:double>")
    rows = responses.withColumn("v", v).withColumn("ids", F.filter(F.coalesce("v.word_ids", F.array().cast("array<int>")), lambda x: F.array_contains("valid", x)))
    known = F.col("v.verdict").isin("accept", "correct", "reject") & ~((F.col("v.verdict") == "correct") & (F.size("ids") == 0))
    ok = F.coalesce(known, F.lit(False))
    return rows.select("docid", "ord", F.when(ok, F.col("v.verdict")).otherwise("accept").alias("verdict"), "ids", F.when(ok, F.coalesce("v.confidence", F.lit(0.5))).otherwise(0.5).alias("confidence"))


def normal_entries(found: Column, catalog: Sequence[str]) -> Column:
    """A map of type to texts with the catalog's keys, trimmed, without empty texts and lists."""
    clean = F.transform_values(found, lambda k, v: F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x != ""))
    return F.map_filter(clean, lambda k, v: k.isin(list(catalog)) & (F.size(v) > 0))


def merge_pages(entries: DataFrame) -> DataFrame:
    """docid, fieldtype, texts over pages (docid, page, fieldtype, texts, listed): single values are the first page's, lists run together."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "texts")))
    both = entries.groupBy("docid", "fieldtype").agg(ordered.alias("x"), F.bool_or("listed").alias("listed"))
    return both.select("docid", "fieldtype", F.when(F.col("listed"), F.flatten(F.transform("x", lambda p: p["texts"]))).otherwise(F.col("x")[0]["texts"]).alias("texts"))


OCR = "struct<pages:array<struct<page_idx:int,blocks:array<struct<lines:array<struct<words:array<struct<value:string,geometry:array<array<double>>,snapped_geometry:array<array<double>>>>>>>>>>>"


def ocr_words(files: DataFrame) -> DataFrame:
    """Words of nested OCR JSON (docid, raw): snapped boxes, else plain ones; a word without either is skipped and takes no number."""
    pages = files.select("docid", F.posexplode(F.from_json("raw", OCR)["pages"]).alias("page", "p"))
    words = F.flatten(F.flatten(F.transform("p.blocks", lambda b: F.transform(b["lines"], lambda x: x["words"]))))
    boxed = F.filter(F.transform(words, lambda w: F.struct(w["value"].alias("text"), F.coalesce(w["snapped_geometry"], w["geometry"]).alias("box"))), lambda w: w["box"].isNotNull())
    rows = pages.select("docid", "page", F.posexplode(boxed).alias("word_id", "w"))
    corner = lambda i, k: F.col("w.box")[i][k]
    return rows.select("docid", "page", "word_id", "w.text", *(corner(i, k).alias(n) for n, i, k in zip(g.SIDES, (0, 0, 1, 1), (0, 1, 0, 1), strict=True)))


def without_snapped(files: DataFrame) -> DataFrame:
    """OCR JSON with every snapped box taken out."""
    strip = lambda b: F.struct(F.transform(b["lines"], lambda x: F.struct(F.transform(x["words"], lambda w: w.dropFields("snapped_geometry")).alias("words"))).alias("lines"))
    page = lambda p: F.struct(p["page_idx"].alias("page_idx"), F.transform(p["blocks"], strip).alias("blocks"))
    return files.withColumn("raw", F.to_json(F.struct(F.transform(F.from_json("raw", OCR)["pages"], page).alias("pages"))))


PREDICTION = "array<struct<fieldtype:string,page:int,bbox:array<double>,score:double,text:string,line_item_id:int,use_only_for_ap:boolean>>"


def predictions(files: DataFrame) -> DataFrame:
    """docid, ord and the fields of {docid: [field]} (one JSON text a row, column raw)."""
    docs = files.select(F.explode(F.from_json("raw", f"map<string,{PREDICTION}>")).alias("docid", "fields"))
    rows = docs.select("docid", F.posexplode("fields").alias("ord", "f")).select("docid", "ord", "f.*")
    return rows.select("docid", "ord", "fieldtype", "page", *(F.col("bbox")[k].alias(n) for k, n in enumerate(g.SIDES)), "score", "text", "line_item_id", "use_only_for_ap")


def prediction_json(fields: DataFrame) -> DataFrame:
    """docid, json: the document's fields as a JSON list in order of ord; a row a document, so a sink of any size is written by many tasks."""
    f = F.struct("ord", F.struct("fieldtype", "page", F.array(*g.SIDES).alias("bbox"), "score", "text", "line_item_id").alias("f"))
    return fields.groupBy("docid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(f)), lambda x: x["f"])).alias("json"))


def training_jsonl(fields: DataFrame) -> DataFrame:
    """docid, page, json: {type: [l, t, r, b] by 1000, cut off}; a type that a page has more than once holds a list of boxes."""
    sides = F.array(*(g.to_thousand_cut(F.col(s)) for s in g.SIDES))
    boxes = fields.groupBy("docid", "page", "fieldtype").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", sides.alias("box")))), lambda x: x["box"]).alias("boxes"))
    text = F.when(F.size("boxes") == 1, F.to_json(F.col("boxes")[0])).otherwise(F.to_json("boxes"))
    entry = F.concat(F.lit('"'), "fieldtype", F.lit('":'), text)
    return boxes.groupBy("docid", "page").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("json"))


def documents(ocr: DataFrame, annotations: DataFrame) -> DataFrame:
    """docid, ocr, annotation of the documents of which both files (docid, raw) are JSON."""
    good = lambda df, name: df.where(F.try_parse_json("raw").isNotNull()).select("docid", F.col("raw").alias(name))
    return good(ocr, "ocr").join(good(annotations, "annotation"), "docid")


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.row, self.col, self.text, self.cells = 0, 0, None, []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("td", "th"):
            self.text = []
        elif tag == "tr":
            self.col = 0

    def handle_endtag(self, tag) -> None:
        if tag in ("td", "th") and self.text is not None:
            self.cells.append((self.row, self.col, " ".join("".join(self.text).split())))
            self.text, self.col = None, self.col + 1
        elif tag == "tr":
            self.row += 1

    def handle_data(self, data) -> None:
        if self.text is not None:
            self.text.append(data)


def table_cells(tables: DataFrame) -> DataFrame:
    """docid, row, col, text of HTML tables (docid, html). HTML need not be well formed, so a parser runs on Arrow batches; spans of cells are ignored."""

    def cells(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for docid, html in zip(b.docid, b.html, strict=True):
                p = _Cells()
                p.feed(html or "")
                rows += [(docid, *c) for c in p.cells]
            yield pd.DataFrame(rows, columns=["docid", "row", "col", "text"])

    kind = T.StructType([tables.schema["docid"], T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("text", T.StringType())])
    return tables.select("docid", "html").mapInPandas(cells, kind)


def gold_json(fields: DataFrame) -> DataFrame:
    """docid, json: {"fields": [{fieldtype, text}], "line_items": [[...]]} with rows in order of their ids."""
    item = F.struct("ord", F.struct("fieldtype", F.coalesce("text", F.lit("")).alias("text")).alias("f"))
    lists = fields.groupBy("docid", "line_item_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("fs"))
    rows = F.array_sort(F.collect_list(F.when(F.col("line_item_id").isNotNull(), F.struct("line_item_id", "fs"))))
    page = F.flatten(F.collect_list(F.when(F.col("line_item_id").isNull(), F.col("fs"))))
    return lists.groupBy("docid").agg(F.to_json(F.struct(page.alias("fields"), F.transform(rows, lambda x: x["fs"]).alias("line_items"))).alias("json"))


def recall_answers(responses: DataFrame, words: DataFrame, targets: Sequence[str], default: float = 0.7, discount: float = 0.7) -> DataFrame:
    """docid, page, ord, fieldtype, score and the box of the named words of answers() for target types; answers that name no known word are dropped."""
    found = answers(responses, targets, default, discount)
    boxes = joins.union_of_words(found.where(F.size("word_ids") > 0).select("docid", "page", "ord", "word_ids"), words, ["ord"])
    return found.select("docid", "page", "ord", "fieldtype", "score").join(boxes.drop("text"), ["docid", "page", "ord"])


CANDIDATE = "struct<word_ids:array<int>,text:string,score:double,line_item_id:int>"


def embedded_candidates(responses: DataFrame) -> DataFrame:
    """docid, ord, word_ids, text, score, line_item_id of the candidates in answers (docid, raw): the whole answer is JSON, or the object that begins with "candidates" in it. Malformed ones are skipped; a score that is missing is .5."""
    whole = unfenced(F.col("raw"))
    listed = lambda s: F.from_json(s, "candidates array<string>")["candidates"]
    inner = F.regexp_extract(whole, r'(?s)(\{ ?"candidates".*)', 1)
    rows = responses.select("docid", F.posexplode(F.coalesce(listed(whole), listed(inner))).alias("ord", "item"))
    parsed = rows.withColumn("c", F.from_json("item", CANDIDATE)).where(F.ltrim("item").startswith("{"))
    bad = F.col("item").rlike(r'"word_ids"\s*:\s*[^\[\s]') | (F.col("item").rlike(r'"word_ids"') & F.col("c.word_ids").isNull()) | (F.col("item").rlike(r'"score"') & F.col("c.score").isNull())
    return parsed.where(~bad).select("docid", "ord", F.coalesce("c.word_ids", F.array().cast("array<int>")).alias("word_ids"), F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.score", F.lit(0.5)).alias("score"), "c.line_item_id")


def script_output(outputs: DataFrame, types: Sequence[str]) -> DataFrame:
    """docid, ord, fieldtype, word_ids of a rule program's output (docid, raw: a JSON list): items that are no object, of unknown type, or whose ids are not all whole numbers are dropped; row ids are not taken over."""
    rows = outputs.select("docid", F.posexplode(F.from_json("raw", "array<string>")).alias("ord", "item"))
    item = F.from_json("item", "struct<fieldtype:string,word_ids:array<int>>")
    whole = F.col("item").rlike(r'"word_ids"\s*:\s*\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]')
    return rows.withColumn("i", item).where(F.col("i.fieldtype").isin(list(types)) & (whole | ~F.col("item").contains('"word_ids"'))).select("docid", "ord", "i.fieldtype", F.coalesce("i.word_ids", F.array().cast("array<int>")).alias("word_ids"))


def table_structure(responses: DataFrame, types: Sequence[str]) -> DataFrame:
    """docid, header_row, columns (column number to type, or null) of answers (docid, raw); unknown types are left out, an answer that does not parse has header 0 and no columns."""
    parsed = F.from_json(unfenced(F.col("raw")), "struct<header_row:int,columns:map<string,string>>")
    null = lambda v: v.isNull() | (v == "null")
    kept = F.map_filter(F.coalesce(F.col("p.columns"), F.create_map().cast("map<string,string>")), lambda k, v: k.rlike(r"^\d+$") & (null(v) | v.isin(list(types))))
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].cast("int").alias("key"), F.when(~null(e["value"]), e["value"]).alias("value")))
    return responses.withColumn("p", parsed).select("docid", F.coalesce("p.header_row", F.lit(0)).alias("header_row"), F.map_from_entries(entries).alias("columns"))


def code_block(raw: Column) -> Column:
    """The program in an answer: after the first ```python, else the first ```, up to the last ```; else the whole."""
    s = F.trim(raw)
    after = lambda mark: F.substring(s, F.instr(s, mark) + len(mark), F.length(s))
    upto = lambda x: F.when(x.contains("```"), F.regexp_replace(x, r"(?s)```(?!.*```).*$", "")).otherwise(x)
    return F.regexp_replace(F.when(s.contains("```python"), upto(after("```python"))).when(s.contains("```"), upto(after("```"))).otherwise(s), r"(?U)^\s+|\s+$", "")


def truncated(code: Column) -> Column:
    """Whether a program looks cut off: empty, or its last line ends in an operator or open bracket, or is neither indented, nor a definition, nor the final return."""
    last = F.regexp_replace(F.substring_index(F.regexp_replace(code, r"\s+$", ""), "\n", -1), r"\s+$", "")
    loose = ~last.startswith("    ") & ~last.startswith("def ") & (last != "return results")
    return (code == "") | last.rlike(r"[,(\[\\+\-*=]$") | loose


def page_rows(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """training_jsonl() for every page (docid, page), {} where it has no fields."""
    return pages.join(training_jsonl(fields), ["docid", "page"], "left").withColumn("json", F.coalesce("json", F.lit("{}")))


def chat_rows(fields: DataFrame, images: DataFrame, prompt: str, system: str) -> DataFrame:
    """docid, json of a chat for each document with an image (docid, image) and fields on page 0 (docid, page, ord, fieldtype, text, left, top, right, bottom): the prompt, and {type: {text, bbox_2d by 1000}}, types in order of their first field, of several the last."""
    sides = F.array(*(g.to_thousand(F.col(s)) for s in g.SIDES))
    one = fields.where("page = 0").groupBy("docid", "fieldtype").agg(F.min("ord").alias("first"), F.max_by(F.struct(F.coalesce("text", F.lit("")).alias("text"), sides.alias("bbox_2d")), "ord").alias("value"))
    entry = F.concat(F.to_json(F.array("fieldtype")).substr(F.lit(2), F.length("fieldtype") + 2), F.lit(":"), F.to_json("value"))
    answers_ = one.groupBy("docid").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", entry.alias("entry")))), lambda x: x["entry"]), ","), F.lit("}")).alias("answer"))
    said = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    chat = F.struct(F.array(said("human", F.lit(prompt)), said("gpt", F.col("answer"))).alias("conversations"), F.lit(system).alias("system"), F.col("image"))
    return images.join(answers_, "docid").select("docid", "answer", F.to_json(chat).alias("json"))


def chat_row_counts(docs: DataFrame, fields: DataFrame, images: DataFrame) -> DataFrame:
    """One row: documents written, and those skipped without an image, or without fields on page 0."""
    has = lambda df, name: df.select("docid").distinct().withColumn(name, F.lit(True))
    both = docs.select("docid").join(has(images, "image"), "docid", "left").join(has(fields.where("page = 0"), "some"), "docid", "left")
    return both.agg(F.count_if(F.col("image") & F.col("some")).alias("written"), F.count_if(F.col("image").isNull()).alias("no_image"), F.count_if(F.col("image") & F.col("some").isNull()).alias("no_fields"))
