"""Evaluation of both tasks, and passes that add to, replace or take away predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions import catalog
from pagefold.operators import analysis, joins
from pagefold.sources import parsing


def run(predicted: DataFrame, gold: DataFrame, words: DataFrame, docs: DataFrame) -> DataFrame:
    """task, ap, precision, recall, f1, n_gold, n_predicted, hits, n_docs, n_missing for page-level (kile) and row-grouped (lir) fields (docid, page, fieldtype, pos, li, l, t, r, b; predictions have a score).

    A prediction hits a gold field of its type and page that holds exactly the same characters. Precision is over all documents at once, by score; ties by
    docid, page, fieldtype and pos. Every document of docs counts; n_missing have no prediction of the task.
    """
    task = lambda df: df.withColumn("task", F.when(F.col("li").isNull(), "kile").otherwise("lir"))
    # a type is matched inside its task only
    typed = lambda df: task(df).withColumn("fieldtype", F.concat_ws(":", "task", "fieldtype"))
    matched = analysis.character_match(typed(predicted).drop("li"), typed(gold).drop("li"), words)
    tasks = docs.sparkSession.createDataFrame([("kile",), ("lir",)], "task string")
    n_gold = tasks.join(task(gold).groupBy("task").agg(F.count("*").alias("n")), "task", "left").select("task", F.coalesce("n", F.lit(0)).alias("n_gold"))
    ap = analysis.average_precision(matched.withColumn("ord", F.struct("docid", "page", "fieldtype", "pos")), n_gold, ["task"])
    counts = n_gold.join(matched.groupBy("task").agg(F.count("*").alias("n_predicted"), F.count_if("hit").alias("hits"), F.countDistinct("docid").alias("with")), "task", "left").fillna(0, ["n_predicted", "hits", "with"])
    n_docs = docs.select("docid").distinct().agg(F.count("*").alias("n_docs"))
    both = analysis.f1(counts, "hits", "n_predicted", "n_gold").join(ap, "task").crossJoin(F.broadcast(n_docs))  # two rows and one
    return both.select("task", "ap", "precision", "recall", "f1", "n_gold", "n_predicted", "hits", "n_docs", (F.col("n_docs") - F.col("with")).alias("n_missing"))


def recall(base: DataFrame, docs: DataFrame, prior: DataFrame, found: DataFrame, multi: Sequence[str] = catalog.MULTI, discount: float = 0.7) -> DataFrame:
    """base and, of found, what its documents (docid, cluster) lack of the types that prior (cluster, fieldtype) expects and that overlaps no field of its type: of single types the best over pages, of multi types all, scores times discount."""
    wanted = joins.missing_types(docs, prior, base.where("li is null"))
    new = joins.without_overlap(found.join(wanted, ["docid", "fieldtype"], "left_semi"), base)
    rank = F.row_number().over(W.partitionBy("docid", "fieldtype").orderBy(F.desc("score"), "page", "pos"))
    kept = new.withColumn("rank", rank).where(F.col("fieldtype").isin(list(multi)) | (F.col("rank") == 1)).drop("rank")
    return base.unionByName(kept.withColumn("score", F.col("score") * discount).select(base.columns))


def recall_counts(base: DataFrame, docs: DataFrame, prior: DataFrame, found: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """One row: documents whose cluster has a prior, those without, documents and types that lack something, pages asked again (pages: docid, page), fields added."""
    mine = docs.join(base.select("docid").distinct(), "docid", "left_semi")
    known = mine.join(prior.select("cluster").distinct(), "cluster", "left_semi")
    lacking = joins.missing_types(known, prior, base.where("li is null"))
    one = lambda df, name, c="*": df.agg((F.count("*") if c == "*" else F.countDistinct(c)).alias(name))
    asked = pages.join(lacking.select("docid").distinct(), "docid", "left_semi")
    added = recall(base, known, prior, found, **options)
    parts = [one(mine, "n"), one(known, "docs_with_cluster"), one(lacking, "docs_lacking", "docid"), one(lacking, "types_lacking"), one(asked, "pages_asked"), one(base, "before"), one(added, "after")]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))  # one row each
    return row.select("docs_with_cluster", (F.col("n") - F.col("docs_with_cluster")).alias("docs_without"), "docs_lacking", "types_lacking", "pages_asked", (F.col("after") - F.col("before")).alias("added"))


def replace_amounts(fields: DataFrame, failures: DataFrame, answers: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """fields where, on pages whose check failed (docid, page), new amounts (as fields) that balance take the place of the old ones; pages whose new ones don't, or are not all there, stay."""
    asked = answers.join(failures.select("docid", "page").distinct(), ["docid", "page"], "left_semi")
    good = analysis.calc_check(asked, tolerance).where("not off").select("docid", "page")
    old = fields.join(good.withColumn("gone", F.lit(True)), ["docid", "page"], "left").where(F.col("gone").isNull() | ~F.col("fieldtype").isin(catalog.AMOUNT_FIELDS)).drop("gone")
    return old.unionByName(asked.join(good, ["docid", "page"], "left_semi").select(old.columns))


def triage(responses: DataFrame) -> DataFrame:
    """docid, fieldtype that a first look (docid, raw: {"present_fields": [...]}) finds; all types of the catalog where it does not parse or names none."""
    named = F.from_json(parsing.unfenced(F.col("raw")), "struct<present_fields:array<string>>")["present_fields"]
    every = F.array(*map(F.lit, sorted(catalog.KILE + catalog.LIR)))
    return responses.select("docid", F.explode(F.when(F.size(named) > 0, named).otherwise(every)).alias("fieldtype")).distinct()


def cross_check(fields: DataFrame, responses: DataFrame) -> DataFrame:
    """fields without the types that a document's corrections (docid, raw: {"corrections": [{fieldtype, action}]}) remove, with all their fields; what does not parse changes nothing."""
    wrong = F.from_json(parsing.unfenced(F.col("raw")), "struct<corrections:array<struct<fieldtype:string,action:string>>>")["corrections"]
    gone = responses.select("docid", F.explode(wrong).alias("c")).where("c.action = 'remove'").select("docid", "c.fieldtype").distinct()
    return fields.join(gone, ["docid", "fieldtype"], "left_anti")


def add_absent(fields: DataFrame, candidates: DataFrame, skip: Sequence[str] = (*catalog.WEAK, *catalog.LIR), least: float = 0.85) -> DataFrame:
    """fields and, for each page-level type that a document lacks, its best candidate over all pages (as fields) from least on; types in skip are not added. The first by page and pos is taken on a tie."""
    new = candidates.where(~F.col("fieldtype").isin(list(skip)) & (F.col("score") >= least)).join(fields.where("li is null").select("docid", "fieldtype").distinct(), ["docid", "fieldtype"], "left_anti")
    rank = F.row_number().over(W.partitionBy("docid", "fieldtype").orderBy(F.desc("score"), "page", "pos"))
    return fields.unionByName(new.withColumn("rank", rank).where("rank = 1").drop("rank").withColumn("li", F.lit(None).cast("int")).select(fields.columns))


def only_docids(rows: DataFrame, docids: DataFrame | None = None, first: int | None = None, order: str = "docid") -> DataFrame:
    """rows of the documents that a list names, or of the first so many by order."""
    if docids is not None:
        rows = rows.join(docids.select("docid").distinct(), "docid", "left_semi")
    if first is not None:
        rows = rows.join(rows.select("docid", order).distinct().orderBy(order, "docid").limit(first).select("docid"), "docid", "left_semi")
    return rows


def targeted(fields: DataFrame, types: Sequence[str] = catalog.TARGETED) -> DataFrame:
    return fields.where(F.col("fieldtype").isin(list(types)))


def strong(fields: DataFrame, weak: Sequence[str] = (*catalog.WEAK, *catalog.LIR)) -> DataFrame:
    """fields of types whose classifiers are not weak."""
    return fields.where(~F.col("fieldtype").isin(list(weak)))

