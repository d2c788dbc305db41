"""Aggregates over clusters, retrieval by likeness, and evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions import geometry as g
from pagefold.functions import text as t


def cluster_prior(annotated: DataFrame, docs: DataFrame, share: float = 0.5) -> DataFrame:
    """cluster, fieldtype, share: types that at least share of the cluster's documents have; documents without fields count. Null and negative clusters are left out."""
    real = lambda df: df.where("cluster >= 0")
    having = real(annotated).select("cluster", "fieldtype", "docid").distinct().groupBy("cluster", "fieldtype").agg(F.count("*").alias("having"))
    size = real(docs).groupBy("cluster").agg(F.countDistinct("docid").alias("size"))
    return having.join(size, "cluster").withColumn("share", F.col("having") / F.col("size")).where(F.col("share") >= share).select("cluster", "fieldtype", "share")


def tightness(fields: DataFrame, first: int = 10, least: int = 3) -> DataFrame:
    """cluster, verdict and the means behind it, from each cluster's first documents (fields: docid, cluster, fieldtype, x, y, text).

    Of each type: presence is fields by documents (it may pass 1), spread the larger population deviation of x and y, shape the share of the most
    common shape of text. TIGHT: means of at least .8, at most .05, at least .7; MEDIUM: at least .5 and at most .1; else LOOSE.
    """
    docs = fields.select("cluster", "docid").distinct()
    chosen = docs.withColumn("n", F.row_number().over(W.partitionBy("cluster").orderBy("docid"))).where(F.col("n") <= first)
    size = chosen.groupBy("cluster").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    rows = fields.join(chosen.select("cluster", "docid"), ["cluster", "docid"]).join(size, "cluster").withColumn("shape", t.shape(F.col("text")))
    by_type = rows.groupBy("cluster", "fieldtype", "docs").agg(F.count("*").alias("n"), F.greatest(F.stddev_pop("x"), F.stddev_pop("y")).alias("spread"))
    common = rows.groupBy("cluster", "fieldtype", "shape").agg(F.count("*").alias("n")).groupBy("cluster", "fieldtype").agg(F.max("n").alias("common"))
    means = by_type.join(common, ["cluster", "fieldtype"]).groupBy("cluster").agg(F.avg(F.col("n") / F.col("docs")).alias("presence"), F.avg("spread").alias("spread"), F.avg(F.col("common") / F.col("n")).alias("shape"))
    tight = (F.col("presence") >= 0.8) & (F.col("spread") <= 0.05) & (F.col("shape") >= 0.7)
    medium = (F.col("presence") >= 0.5) & (F.col("spread") <= 0.10)
    return means.withColumn("verdict", F.when(tight, "TIGHT").when(medium, "MEDIUM").otherwise("LOOSE"))


def coverage(docs: DataFrame, verdicts: DataFrame, train: DataFrame) -> DataFrame:
    """verdict, n of documents: that of their cluster; NO_MATCH if no training document has it, UNANALYZABLE if it has no verdict."""
    known = train.select("cluster").distinct().withColumn("known", F.lit(True))
    both = docs.join(verdicts.select("cluster", "verdict"), "cluster", "left").join(known, "cluster", "left")
    name = F.when(F.col("known").isNull(), "NO_MATCH").otherwise(F.coalesce("verdict", F.lit("UNANALYZABLE")))
    return both.groupBy(name.alias("verdict")).agg(F.count("*").alias("n"))


def entity_vector(fields: DataFrame, types: Sequence[str]) -> DataFrame:
    """docid, vector: 1 where the document has the type, in the order of types."""
    have = fields.groupBy("docid").agg(F.collect_set("fieldtype").alias("have"))
    return have.select("docid", F.array(*(F.array_contains("have", x).cast("int") for x in types)).alias("vector"))


def nearest(queries: DataFrame, index: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """query, id, sim, label, rank of the k index rows (id, vector, label) whose vectors have the largest product with each query's (query, vector), rounded to six places, the smaller id first on a tie; a row with the query's own id doesn't count.

    The index stays where it is: queries go to it in broadcast blocks of at most block vectors, and a task compares its rows with a block as a
    matrix product. It returns rows that reach the k-th best it has seen for a query, so few more than k for each query and task are shuffled.
    """
    spark = queries.sparkSession
    numbered = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() // block)))))
    blocks = [r["block"] for r in numbered.select("block").distinct().collect()]  # one row for each pass over the index
    light = index.select("id", F.col("vector").cast("array<double>").alias("vector"), "label")

    def against(b: int) -> DataFrame:
        got = numbered.where(F.col("block") == b).toArrow()
        shared = spark.sparkContext.broadcast((got.column("query").to_numpy(), np.array(got.column("vector").to_pylist())))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            reach = np.full(len(names), -np.inf)
            for batch in batches:
                for k0 in range(0, batch.num_rows, 512):
                    part = batch.slice(k0, 512)
                    ids, label = part.column(0).to_numpy(), part.column(2)
                    sim = np.round(q @ part.column(1).flatten().to_numpy().reshape(len(ids), -1).T, 6)
                    sim[names[:, None] == ids] = -np.inf
                    if len(ids) >= k:
                        reach = np.maximum(reach, np.partition(sim, -k, axis=1)[:, -k])
                    who, what = np.nonzero((sim >= reach[:, None]) & (sim > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(ids[what]), pa.array(sim[who, what]), label.take(pa.array(what))], ["query", "id", "sim", "label"])

        kind = f"query long, id long, sim double, label {light.schema['label'].dataType.simpleString()}"
        return light.mapInArrow(work, kind)

    if not blocks:
        return spark.createDataFrame([], f"query long, id long, sim double, label {light.schema['label'].dataType.simpleString()}, rank int")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return reduce(DataFrame.unionByName, map(against, blocks)).withColumn("rank", rank).where(F.col("rank") <= k)


def majority(neighbours: DataFrame) -> DataFrame:
    """query, label with the most neighbours; the one whose best neighbour is nearest on a tie."""
    count = neighbours.groupBy("query", "label").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    return count.groupBy("query").agg(F.max_by("label", F.struct("n", -F.col("best"))).alias("label"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, mean and quartiles of sim (linear between ranks), share over .8 and under .6, of predicted (label, truth, sim)."""
    q = F.percentile("sim", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return predicted.agg(F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"), F.avg("sim").alias("mean"), q.alias("q"), F.avg((F.col("sim") > 0.8).cast("double")).alias("high"), F.avg((F.col("sim") < 0.6).cast("double")).alias("low")).select("accuracy", "mean", *(F.col("q")[k].alias(n) for k, n in enumerate(("p25", "median", "p75"))), "high", "low")


def jaccard(queries: DataFrame, index: DataFrame, k: int = 1) -> DataFrame:
    """query, id, jaccard of the k rows whose token sets (query|id, token, distinct) are most like, among those that share a token. Sets meet on tokens, so pairs without any in common never arise."""
    qn = queries.groupBy("query").agg(F.count("*").alias("qn"))
    xn = index.groupBy("id").agg(F.count("*").alias("xn"))
    both = queries.join(index, "token").groupBy("query", "id").agg(F.count("*").alias("both"))
    sim = F.col("both") / (F.col("qn") + F.col("xn") - F.col("both"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("jaccard"), "id"))
    return both.join(qn, "query").join(xn, "id").select("query", "id", sim.alias("jaccard")).withColumn("rank", rank).where(F.col("rank") <= k)


def buckets(values: DataFrame, column: str) -> DataFrame:
    """One row: median, mean, min, max, and counts under .3, .5, .7 and above."""
    c = F.col(column)
    cut = {"under_3": c < 0.3, "under_5": (c >= 0.3) & (c < 0.5), "under_7": (c >= 0.5) & (c < 0.7), "above": c >= 0.7}
    return values.agg(F.percentile(c, F.lit(0.5)).alias("median"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), *(F.count_if(x).alias(n) for n, x in cut.items()))


def average_precision(matches: DataFrame, n_gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ap: over rows by score (ties by ord), the precision at each hit, summed and divided by the number of gold fields; null without any.

    matches: keys, score, ord, hit. The running counts are windows over each key.
    """
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    ranked = matches.withColumn("rank", F.row_number().over(order)).withColumn("hits", F.sum(F.col("hit").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    total = ranked.where("hit").groupBy(*keys).agg(F.sum(F.col("hits") / F.col("rank")).alias("total"))
    return n_gold.join(total, list(keys), "left").select(*keys, F.try_divide(F.coalesce("total", F.lit(0.0)), "n_gold").alias("ap"))


def f1(counts: DataFrame, hits: str, predicted: str, gold: str) -> DataFrame:
    p, r = F.coalesce(F.try_divide(hits, predicted), F.lit(0.0)), F.coalesce(F.try_divide(hits, gold), F.lit(0.0))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def gate(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, steps: Sequence[tuple[float, str]] = ((1.0, "strong"), (0.5, "good"), (0.0, "neutral")), worse: str = "worse") -> DataFrame:
    """keys, delta (b - a) and the verdict of the first step it reaches."""
    both = a.join(b.withColumnRenamed(value, "other"), list(keys)).withColumn("delta", F.col("other") - F.col(value))
    verdict = F.lit(worse)
    for least, name in reversed(steps):
        verdict = F.when(F.col("delta") >= least, name).otherwise(verdict)
    return both.select(*keys, "delta", verdict.alias("verdict"))


def character_match(predicted: DataFrame, gold: DataFrame, words: DataFrame) -> DataFrame:
    """predicted (docid, page, fieldtype, pos, score, l, t, r, b) with hit: whether a gold field of its type and page holds exactly the same characters.

    A word of n characters has n centres, at (i + .5) / n of its width and half its height. A gold field is hit once, by the best score (first pos on a tie).
    """
    n = F.length("text")
    chars = words.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select("docid", "page", "word_id", "i", (F.col("left") + (F.col("i") + 0.5) / n * (F.col("right") - F.col("left"))).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"))

    def held(boxes: DataFrame) -> DataFrame:
        keys = ["docid", "page", "fieldtype", "pos"]
        inside = boxes.join(chars, ["docid", "page"]).where(g.holds(g.box("", ("l", "t", "r", "b")), F.col("x"), F.col("y")))
        return inside.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("word_id", "i"))).alias("chars"))

    a = predicted.join(held(predicted), ["docid", "page", "fieldtype", "pos"])
    b = held(gold).select("docid", "page", "fieldtype", "chars", F.col("pos").alias("gold"))
    nth = lambda df, *order: df.withColumn("nth", F.row_number().over(W.partitionBy("docid", "page", "fieldtype", "chars").orderBy(*order)))
    hit = nth(a, F.desc("score"), "pos").join(nth(b, "gold"), ["docid", "page", "fieldtype", "chars", "nth"]).select("docid", "page", "fieldtype", "pos", F.lit(True).alias("hit"))
    return predicted.join(hit, ["docid", "page", "fieldtype", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def set_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """docid, f1 of the sets of (fieldtype, normal text)."""
    item = F.concat_ws("\x1f", "fieldtype", t.metric_text(F.col("text")))
    p = predicted.groupBy("docid").agg(F.collect_set(item).alias("p"))
    q = gold.groupBy("docid").agg(F.collect_set(item).alias("q"))
    both = p.join(q, "docid", "outer").select("docid", F.coalesce("p", F.array().cast("array<string>")).alias("p"), F.coalesce("q", F.array().cast("array<string>")).alias("q"))
    counts = both.select("docid", F.size(F.array_intersect("p", "q")).alias("hits"), F.size("p").alias("np"), F.size("q").alias("nq"))
    return f1(counts, "hits", "np", "nq").select("docid", "f1")


def calc_check(amounts: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """docid, page, gross, net, tax, off: the best amounts of each page (docid, page, fieldtype, text, score) where all three parse, and whether gross - (net + tax) is more than tolerance of gross."""
    names = {"gross": "amount_total_gross", "net": "amount_total_net", "tax": "amount_total_tax"}
    # parsed once, below the aggregate, and only for the three types
    parsed = amounts.where(F.col("fieldtype").isin(list(names.values()))).select("docid", "page", "fieldtype", "score", t.parse_amount(F.col("text")).alias("value"))
    best = [F.max_by(F.when(F.col("fieldtype") == ft, F.col("value")), F.when(F.col("fieldtype") == ft, F.col("score"))).alias(n) for n, ft in names.items()]
    pages = parsed.groupBy("docid", "page").agg(*best).dropna(subset=list(names))
    off = F.abs(F.col("gross") - (F.col("net") + F.col("tax"))) / F.greatest(F.abs("gross"), F.lit(0.01))
    return pages.withColumn("off", off > tolerance)


def demote_amounts(amounts: DataFrame, checks: DataFrame, factor: float = 0.5) -> DataFrame:
    bad = checks.where("off").select("docid", "page", F.lit(True).alias("bad"))
    return amounts.join(bad, ["docid", "page"], "left").withColumn("score", F.when(F.col("bad"), F.col("score") * factor).otherwise(F.col("score"))).drop("bad")


def augment(base: DataFrame, found: DataFrame, multi: Sequence[str], discount: float = 0.7) -> DataFrame:
    """base and, of found, types that the document lacks: of single types the best over pages, of multi types all; scores times discount."""
    new = found.join(base.select("docid", "fieldtype").distinct(), ["docid", "fieldtype"], "left_anti")
    rank = F.row_number().over(W.partitionBy("docid", "fieldtype").orderBy(F.desc("score"), "page", "pos"))
    kept = new.withColumn("rank", rank).where(F.col("fieldtype").isin(list(multi)) | (F.col("rank") == 1)).drop("rank")
    return base.unionByName(kept.withColumn("score", F.col("score") * discount))


def apply_verdicts(fields: DataFrame, verdicts: DataFrame, least: float = 0.6) -> DataFrame:
    """fields (docid, fieldtype, pos, word_ids) after verdicts (docid, fieldtype, pos, verdict, ids, confidence): sure rejects go, sure corrections take the verdict's ids, all else stays."""
    sure = F.col("confidence") >= least
    both = fields.join(verdicts, ["docid", "fieldtype", "pos"], "left")
    kept = both.where(~F.coalesce(sure & (F.col("verdict") == "reject"), F.lit(False)))
    ids = F.when(sure & (F.col("verdict") == "correct") & (F.size("ids") > 0), F.col("ids")).otherwise(F.col("word_ids"))
    return kept.select("docid", "fieldtype", "pos", ids.alias("word_ids"))


def rerank(fields: DataFrame, least: float = 0.3) -> DataFrame:
    """fields (with p, a classifier's probability or null): null stays, under least goes, else the score is times p."""
    return fields.where(F.col("p").isNull() | (F.col("p") >= least)).withColumn("score", F.col("score") * F.coalesce("p", F.lit(1.0)))


def soft_rerank(fields: DataFrame, least: float = 0.7) -> DataFrame:
    return fields.withColumn("score", F.col("score") * F.greatest(F.coalesce("p", F.lit(1.0)), F.lit(least)))


def script_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """docid, hits, n: gold fields (docid, fieldtype, ids) of which a found field of the type has a word; gold without words is left out."""
    real = gold.where(F.size("ids") > 0).withColumn("gid", F.monotonically_increasing_id())
    by = found.groupBy("docid", "fieldtype").agg(F.flatten(F.collect_list("ids")).alias("found"))
    both = real.join(by, ["docid", "fieldtype"], "left").withColumn("hit", F.coalesce(F.arrays_overlap("ids", "found"), F.lit(False)))
    return both.groupBy("docid").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def miss_reason(instances: DataFrame) -> DataFrame:
    """docid, fieldtype, reason of missed fields, from traces (docid, fieldtype, triaged, n_candidates, removed, verdict, confidence): the first that holds."""
    a = instances.groupBy("docid", "fieldtype").agg(F.bool_or("triaged").alias("triaged"), F.sum("n_candidates").alias("n"), F.bool_or("removed").alias("removed"), F.bool_and((F.col("verdict") == "reject") & (F.col("confidence") >= 0.6)).alias("rejected"))
    reason = F.when(~F.col("triaged"), "triage_skipped").when(F.col("n") == 0, "agent_returned_empty").when(F.col("removed"), "verifier_removed").when(F.col("rejected"), "span_rejected").otherwise("agent_returned_wrong")
    return a.select("docid", "fieldtype", reason.alias("reason"))
