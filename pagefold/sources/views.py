"""Tables in the engine's schemas, read from a folder of Parquet files.

words: docid, page, word_id (place on the page, from 0), text, left, top, right, bottom
fields: source k, docid, pos (order in the source), fieldtype, page, left, top, right, bottom, score, li (row id or null), text
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.pages import Words, places, sizes

PAGE = ("docid", "page")
PAGE_LINES = 4


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_lines(spark: SparkSession, folder: str, by: Sequence[str] = PAGE) -> DataFrame:
    """docid, page, lines of every page, with a word or without; dealt by some of docid and page."""
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("docid"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(0), ((F.size("lines") - 1) / PAGE_LINES).cast("int"))
    pages = docs.select("docid", F.posexplode(F.transform(starts, lambda p: F.slice("lines", p * PAGE_LINES + 1, PAGE_LINES))).alias("page", "lines"))
    # what is grouped or joined by page, and more, then stays where it is: a page's text is shuffled once and its words never
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return pages.repartition(*by)


def _page_cells(spark: SparkSession, folder: str, by: Sequence[str] = PAGE) -> DataFrame:
    """docid, page, found: the page's words with their row and column, for every page with a word."""
    pages = page_lines(spark, folder, by)
    cell = lambda r: lambda w, c: F.struct(w.alias("text"), r.alias("r"), c.alias("c"))
    row = lambda line, r: F.filter(F.transform(F.split(line, " ", -1), cell(r)), lambda x: x["text"] != "")
    return pages.select("docid", "page", F.flatten(F.transform("lines", row)).alias("found"))


def words(spark: SparkSession, folder: str, by: Sequence[str] = PAGE) -> DataFrame:
    """Every word of documents on a grid: lines are rows, PAGE_LINES of them a page. Built in each page's row, so nothing is shuffled for the word numbers; pages are dealt by their keys, or by docid alone for what needs whole documents."""
    # outer: else Spark infers a filter on the words, moves it below the shuffle, and the shuffles of a plan differ and are not shared
    flat = _page_cells(spark, folder, by).select("docid", "page", F.posexplode_outer("found").alias("word_id", "w")).where("word_id is not null")
    left, top = F.col("w.c") / 128.0, F.col("w.r") / 32.0 + F.pmod(F.col("w.c") * 7, F.lit(5)) / 1024.0
    return flat.select("docid", "page", "word_id", "w.text", left.alias("left"), top.alias("top"), (left + F.length("w.text") / 1024.0).alias("right"), (top + 8 / 1024.0).alias("bottom"))


def words_of(lines: pa.Array) -> Words:
    """words() of page_lines' lines, in arrays."""
    flat, lines_of = lines.flatten(), sizes(lines)
    parts = pc.split_pattern(flat, " ")
    cells = sizes(parts)
    text, line = parts.flatten(), np.repeat(np.arange(len(flat)), cells)
    some = pc.fill_null(pc.not_equal(text, ""), False)
    there = some.to_numpy(zero_copy_only=False)
    c, line, text = places(np.zeros(len(flat), np.int64), cells)[there], line[there], text.filter(some)
    page = np.repeat(np.arange(len(lines)), lines_of)[line]
    r = places(np.zeros(len(lines), np.int64), lines_of)[line]
    ids = np.arange(len(page)) - np.searchsorted(page, page)
    left, top = c / 128.0, r / 32.0 + c * 7 % 5 / 1024.0
    return Words(page, ids, text, left, top, left + pc.utf8_length(text).to_numpy(zero_copy_only=False) / 1024.0, top + 8 / 1024.0)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """docid, page of every page with a word, without making the words."""
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("docid"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    all_ = docs.select("docid", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.size("lines") - 1) / PAGE_LINES).cast("int")), lambda p: F.exists(F.slice("lines", p * PAGE_LINES + 1, PAGE_LINES), lambda x: F.trim(x) != ""))).alias("page", "some"))
    return all_.where("some").select("docid", "page")


WORDS = """words as (
  select docid, page, cast(row_number() over (partition by docid, page order by r, c) - 1 as int) as word_id, text,
    c / 128.0 as "left", r / 32.0 + ((c * 7) % 5) / 1024.0 as top, c / 128.0 + length(text) / 1024.0 as "right",
    r / 32.0 + ((c * 7) % 5) / 1024.0 + 8 / 1024.0 as bottom
  from (select docid, cast(line // 4 as int) as page, cast(line % 4 as double) as r, cast(unnest(range(len(ws))) as double) as c, unnest(ws) as text
    from (select docid, line, string_split(t, ' ') as ws from (
      select doc_id as docid, unnest(range(len(ls))) as line, unnest(ls) as t from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))))
  where text <> '')"""

#: What some words are replaced by, by word_id modulo 29, so that pages hold labels, amounts and codes; the same text in both engines.
_MIXED = """case word_id % 29
  when 0 then element_at(array('To:', 'No:', 'Total:', 'VAT', 'Account', 'Swift', 'Ref.', 'Invoice'), cast(word_id / 29 as int) % 8 + 1)
  when 1 then concat(word_id * 37 + 10, '.50') when 2 then 'EUR' when 4 then concat('DE', lpad(cast(docid * 7919 + word_id as string), 9, '0'))
  when 6 then lpad(cast(docid * 104729 + word_id as string), 10, '0') when 8 then 'DEUTDEFF' when 10 then 'DE89370400440532013000'
  when 12 then 'GB29' when 13 then 'NWBK' when 14 then '6016' when 15 then '1331' when 16 then '9268' when 17 then '19'
  when 20 then concat(docid % 28 + 1, '.', word_id % 12 + 1, '.2024') else text end"""
MIXED = """mixed as (select docid, page, word_id, case word_id % 29
  when 0 then ['To:', 'No:', 'Total:', 'VAT', 'Account', 'Swift', 'Ref.', 'Invoice'][word_id // 29 % 8 + 1]
  when 1 then concat(word_id * 37 + 10, '.50') when 2 then 'EUR' when 4 then concat('DE', lpad(cast(docid * 7919 + word_id as varchar), 9, '0'))
  when 6 then lpad(cast(docid * 104729 + word_id as varchar), 10, '0') when 8 then 'DEUTDEFF' when 10 then 'DE89370400440532013000'
  when 12 then 'GB29' when 13 then 'NWBK' when 14 then '6016' when 15 then '1331' when 16 then '9268' when 17 then '19'
  when 20 then concat(docid % 28 + 1, '.', word_id % 12 + 1, '.2024') else text end as text, "left", top, "right", bottom from words)"""


def mixed(spark: SparkSession, folder: str, by: Sequence[str] = PAGE) -> DataFrame:
    """words, with labels, amounts and codes among them."""
    return words(spark, folder, by).withColumn("text", F.expr(_MIXED))


#: Three jittered sources of predictions; the same text in both engines.
_FIELDS = """select l_partkey as docid, concat(l_returnflag, l_linestatus) as fieldtype, cast(l_linenumber % 2 as int) as page, cast(k as int) as k,
  cast(row_number() over (partition by l_partkey, k order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as bigint) as pos,
  cast((l_orderkey % 6) * 4 + k * (l_suppkey % 3) as double) as l, cast((l_suppkey % 4) * 3 + k * (l_orderkey % 2) as double) as t,
  cast((l_orderkey % 6) * 4 + k * (l_suppkey % 3) + 20 as double) as r, cast((l_suppkey % 4) * 3 + k * (l_orderkey % 2) + 12 as double) as b,
  cast(50 + (l_orderkey * 7 + k * 13) % 50 as double) / 100 as score, case when l_linenumber > 4 then cast(l_linenumber as int) end as li
  from {lineitem}"""
FIELDS = f"fields as ({_FIELDS.format(lineitem='(select *, unnest([0, 1, 2]) as k from lineitem)')})"


def fields(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_FIELDS, lineitem=read(spark, folder, "lineitem").withColumn("k", F.explode(F.array(*map(F.lit, range(3))))))


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """docid, cluster, fieldtype, text, ord of annotated fields: orders stand for documents, nations for clusters."""
    o, c = read(spark, folder, "orders"), read(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("docid"), F.col("c_nationkey").alias("cluster"), F.col("o_orderpriority").alias("fieldtype"), F.col("o_orderstatus").alias("text"), F.col("o_orderkey").alias("ord"))


ANNOTATED = "annotated as (select o_orderkey as docid, c_nationkey as cluster, o_orderpriority as fieldtype, o_orderstatus as text, o_orderkey as ord from orders join customer on o_custkey = c_custkey)"
