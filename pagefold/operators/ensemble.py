"""Merging predictions of several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions import geometry as g

MODES = ("weighted_max", "weighted_mean", "vote")
BOX = ("l", "t", "r", "b")


def greedy_step(threshold: float):
    """A fold's step over items (structs with a box l, t, r, b, in order) that gives each g: the first group with any member of that overlap or more, else a new group.

    A fold, not connected components: an item that touches two groups joins the first and leaves both as they are.
    """

    def add(done: Column, x: Column) -> Column:
        near = F.filter(done, lambda y: g.iou(g.of(y, BOX), g.of(x, BOX)) >= threshold)
        first = F.array_min(F.transform(near, lambda y: y["g"]))
        fresh = F.coalesce(F.array_max(F.transform(done, lambda y: y["g"])), F.lit(-1)) + 1
        return F.array_append(done, F.struct(x.alias("item"), *(x[c].alias(c) for c in BOX), F.coalesce(first, fresh).alias("g")))

    return add


def clustered(fields: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """fields (with box l, t, r, b) with column g, numbered in each bucket of keys, in order of the columns of order.

    One shuffle by the keys; a bucket (a field type on a page) is one array.
    """
    rest = [c for c in fields.columns if c not in keys]
    lead = [*order, *(c for c in rest if c not in order)]
    buckets = fields.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*lead))).alias("items"))
    kind = fields.select(F.struct(*lead).alias("x")).schema["x"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<item:{kind},l:double,t:double,r:double,b:double,g:int>>")
    out = buckets.select(*keys, F.inline(F.aggregate("items", empty, greedy_step(threshold))))
    return out.select(*keys, "item.*", "g")


def combine_scores(mode: str, n_sources: int) -> Column:
    """Of a group's rows of one source each (best, weight): the largest product, at most 1; the weighted mean; or the share of sources."""
    if mode not in MODES:
        raise ValueError(f"score_combine must be one of {MODES}")
    if mode == "weighted_max":
        return F.least(F.max(F.col("best") * F.col("weight")), F.lit(1.0))
    if mode == "weighted_mean":
        return F.try_divide(F.sum(F.col("best") * F.col("weight")), F.sum("weight"))
    total = F.sum("weight")
    return F.least(F.when(F.count("*") == n_sources, F.lit(1.0)).otherwise(total / n_sources), F.lit(1.0))


def merge(fields: DataFrame, n_sources: int, weights: Sequence[float] | None = None, threshold: float = 0.5, mode: str = "weighted_max") -> DataFrame:
    """docid, fieldtype, page, li, g, l, t, r, b, score, n_sources of merged fields.

    A bucket is a field type on a page, and a row id if there is one. A group's box is that of the row with the largest score by
    weight, the first on a tie. Row ids are null-safe: rows without one are apart from all others.
    """
    weights = list(weights) if weights is not None else [1.0] * n_sources
    if len(weights) != n_sources:
        raise ValueError("weights must have one entry for each source")
    if mode not in MODES:
        raise ValueError(f"score_combine must be one of {MODES}")
    keys = ["docid", "fieldtype", "page", "li"]
    grouped = clustered(fields, keys, ["k", "pos"], threshold).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1))
    lead = F.struct(F.col("score") * F.col("weight"), -F.col("k"), -F.col("pos"))
    by_source = grouped.groupBy(*keys, "g", "k", "weight").agg(F.max("score").alias("best"), F.max_by(F.struct(*BOX), lead).alias("box"), F.max(lead).alias("lead"))
    out = by_source.groupBy(*keys, "g").agg(F.max_by("box", "lead").alias("box"), combine_scores(mode, n_sources).alias("score"), F.count("*").alias("n_sources"))
    return out.select(*keys, "g", "box.*", "score", "n_sources")


def self_consistency(fields: DataFrame, runs: int, share: float = 0.3, min_votes: int | None = None) -> DataFrame:
    """Fields of run 0 that enough runs confirm: votes is the number of runs with a field of that type and page whose overlap with it is share or more, itself one.

    The score is the smaller of votes / runs and the best score among those fields.
    """
    need = min_votes if min_votes is not None else max(1, (runs + 1) // 2)
    a, b = fields.where("k = 0").alias("a"), fields.where("k > 0").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("docid", "fieldtype", "page")]
    near = g.overlaps(g.box("a.", BOX), g.box("b.", BOX), share)
    names = ["docid", "fieldtype", "page", "pos"]
    votes = a.join(b, [*same, near], "left").groupBy(*(F.col(f"a.{c}") for c in (*names, *BOX)), F.col("a.score").alias("own")).agg((F.countDistinct("b.k") + 1).alias("votes"), F.max("b.score").alias("other"))
    return votes.where(F.col("votes") >= need).select(*names, *BOX, "votes", F.least(F.col("votes") / runs, F.greatest("own", F.coalesce("other", F.lit(0.0)))).alias("score"))


def best_of_page(fields: DataFrame, multi: Sequence[str] = ()) -> DataFrame:
    """One row for each docid, fieldtype and page: the best score, the first on a tie. Row-grouped fields and types in multi stay as they are."""
    exempt = F.col("li").isNotNull() | F.col("fieldtype").isin(list(multi))
    rank = F.row_number().over(W.partitionBy("docid", "fieldtype", "page", exempt).orderBy(F.desc("score"), "k", "pos"))
    return fields.withColumn("rank", rank).where(exempt | (F.col("rank") == 1)).drop("rank")


def best_of_words(candidates: DataFrame) -> DataFrame:
    """docid, page, ids, score, place: one row for each page and set of word_ids, with the best score; place is its number in the document by score, then page and ids. Candidates without words are one set."""
    key = F.array_sort(F.array_distinct(F.coalesce("word_ids", F.array().cast("array<int>"))))
    best = candidates.withColumn("ids", key).groupBy("docid", "page", "ids").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("docid").orderBy(F.desc("score"), "page", "ids")))


def best_of_text(finds: DataFrame) -> DataFrame:
    """docid, fieldtype, code, page, k, pos, score: the best find of each text over all pages, the first on a tie; texts are alike in upper case without white space, and nulls are alike."""
    code = F.upper(F.regexp_replace("text", r"\s+", ""))
    rank = F.row_number().over(W.partitionBy("docid", "fieldtype", "code").orderBy(F.desc("score"), "page", "k", "pos"))
    return finds.withColumn("code", code).withColumn("rank", rank).where("rank = 1").select("docid", "fieldtype", "code", "page", "k", "pos", "score")


def type_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """docid, fieldtype, side: types a document has in a alone, in b alone, or in both."""
    key = ["docid", "fieldtype"]
    one = a.select(*key, F.lit(1).alias("side")).unionByName(b.select(*key, F.lit(2).alias("side"))).groupBy(*key).agg(F.bit_or("side").alias("side"))
    return one.select(*key, F.element_at(F.array(*map(F.lit, ("a", "b", "both"))), F.col("side")).alias("side"))


def in_sources(fields: DataFrame, n_sources: int) -> DataFrame:
    """docid and n0, n1, ...: how many fields each source k has, for every document of any source."""
    return fields.groupBy("docid").agg(*(F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(n_sources)))


def replace_types(base: DataFrame, other: DataFrame, types: Sequence[str]) -> DataFrame:
    """base, where other has a field of one of types in a document, with other's in place of its own."""
    new = other.where(F.col("fieldtype").isin(list(types)))
    return base.join(new.select("docid", "fieldtype").distinct(), ["docid", "fieldtype"], "left_anti").unionByName(new.select(base.columns))


def cover(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """docid and n_fields of every document, 0 where it has none."""
    return docs.join(fields.groupBy("docid").agg(F.count("*").alias("n")), "docid", "left").select("docid", F.coalesce("n", F.lit(0)).alias("n_fields"))


def split_rows(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page-level, row-grouped): by the row id, not by the type's name."""
    return fields.where("li is null"), fields.where("li is not null")
