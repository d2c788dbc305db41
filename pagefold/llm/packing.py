"""Packing into optimal length buckets.

The histogram of lengths over all documents goes to the driver; dynamic programming chooses the bucket boundaries that minimise the
padding in total. Every length is counted by itself, so the boundaries are the optimum. The histogram's size is bounded by the
corpus: d different lengths take at least d * (d + 1) / 2 tokens, so 10 ** 13 tokens (some 100 TB of text) have 4.5 million
lengths at most, and texts of up to n tokens have n. Of equally good boundaries the last bucket begins as early as it can, then
the one before it, and so on. Every document is padded to its bucket's boundary, and inside a bucket documents
are numbered in order of doc_id and cut into batches of as many as the token budget holds at that padded length; a document
longer than the budget has a batch of its own. Nothing is cut off or left out, however long a text is.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.llm.common import positions, written

BUCKETS, BUDGET = 16, 65_536


def word_count(text: str = "text") -> Column:
    """Words of a text between ASCII white space; null: 0."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def histogram(rows: DataFrame, column: str = "n_tokens") -> tuple[np.ndarray, np.ndarray]:
    """The lengths that occur, ascending, and how many rows have each; a length of 0 counts as 1."""
    counts = rows.groupBy(F.greatest(F.col(column), F.lit(1)).alias("size")).agg(F.count("*").alias("n")).toArrow()
    sizes, n = counts.column("size").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(sizes)
    return sizes[order], n[order]


def boundaries(sizes: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Of ascending sizes with counts, the at most buckets boundaries (some of the sizes, the last among them) with the least padding.

    least[j]: the fewest padded tokens of sizes up to j, in one more bucket each time round. With a last bucket from i on it is
    least[i - 1] + size[j] * (rows from i to j), a line in size[j] for each i; as both slopes and sizes are in order, the lower hull
    of the lines gives all minima in one pass, so a round takes time in proportion to the number of sizes. Of equal minima the
    smallest i counts. As long as there are fewer buckets than sizes, one more always saves padding, so all are used.
    """
    sizes, counts = list(map(int, sizes)), list(map(int, counts))
    if not sizes:
        return []
    rows = list(accumulate(counts, initial=0))
    least, starts = [s * n for s, n in zip(sizes, rows[1:], strict=True)], []
    for k in range(1, min(buckets, len(sizes))):
        hull: deque[tuple[int, int, int]] = deque()  # slope, height at 0, start
        now, start = list(least), array("l", bytes(8 * len(sizes)))
        for j in range(k, len(sizes)):
            m, c = -rows[j], least[j - 1]
            while len(hull) > 1 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, c, j))
            while len(hull) > 1 and hull[1][0] * sizes[j] + hull[1][1] < hull[0][0] * sizes[j] + hull[0][1]:
                hull.popleft()
            now[j], start[j] = hull[0][0] * sizes[j] + hull[0][1] + sizes[j] * rows[j + 1], hull[0][2]
        least = now
        starts.append(start)
    out, j = [sizes[-1]], len(sizes) - 1
    for start in reversed(starts):
        j = start[j] - 1
        out.append(sizes[j])
    return out[::-1]


def assign(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), padded (its boundary), batch (number in the bucket, from 0), slot (place in the batch) for rows (doc_id, n_tokens).

    Boundaries are lengths that documents have. Null ids come first in a bucket; rows that repeat an id follow each other.
    No rows: no rows.
    """
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    rows = written(rows, "lengths")  # read three times: for the histogram, the ranges and the batches
    cuts = boundaries(*histogram(rows), buckets)
    padded = F.coalesce(*(F.when(F.col("n_tokens") <= c, F.lit(c)) for c in cuts), F.lit(0)).cast("long") if cuts else F.lit(0).cast("long")
    number = F.coalesce(*(F.when(F.col("n_tokens") <= c, F.lit(k)) for k, c in enumerate(cuts)), F.lit(0)).cast("int")
    placed = positions(rows.withColumn("bucket", number).withColumn("padded", padded), ["bucket", "doc_id", "n_tokens"])
    # rows of a bucket in earlier partitions: a row for each partition and bucket, so partitions + buckets of them
    counts = placed.groupBy("pid", "bucket").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("bucket").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("pid", "bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("long")
    ranked = placed.join(F.broadcast(offsets), ["pid", "bucket"]).withColumn("rank", F.col("at") + F.col("offset"))
    return ranked.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("rank") / capacity).cast("long").alias("batch"), F.pmod(F.col("rank"), capacity).cast("long").alias("slot"))


def pack(docs: DataFrame, **limits) -> DataFrame:
    """assign() for docs (doc_id, text; others are left out), a token being a word of the text."""
    return assign(docs.select("doc_id", word_count().alias("n_tokens")), **limits)


def _filled(placed: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """placed with the column value of values (doc_id, n_tokens, value): rows of one id and length are interchangeable, each is given out once."""
    once = W.partitionBy("doc_id", "n_tokens")
    left = placed.withColumn("k", F.row_number().over(once.orderBy("bucket", "batch", "slot")))
    right = values.withColumn("k", F.row_number().over(once.orderBy(value)))
    same = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["n_tokens"] == right["n_tokens"]) & (left["k"] == right["k"])
    return left.join(right, same).select(left["*"], right[value])


def _batched(rows: DataFrame, value: str, name: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("slot", F.struct("doc_id", value).alias("doc"))))
    out = rows.groupBy("bucket", "batch", "padded").agg(items.alias("items"), F.sum("n_tokens").alias("n_tokens"))
    return out.select("bucket", "batch", "padded", F.col("items.doc.doc_id").alias("doc_ids"), F.col(f"items.doc.{value}").alias(name), "n_tokens", (F.col("padded") * F.size("items") - F.col("n_tokens")).alias("padding"))


def batches(docs: DataFrame, **limits) -> DataFrame:
    """A row for each batch: bucket, batch, padded, doc_ids, texts in order of slot, n_tokens, padding. A batch holds the budget's tokens at most, or one document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", word_count().alias("n_tokens"))
    return _batched(_filled(pack(docs, **limits), texts, "text"), "text", "texts")


def token_batches(tokens: DataFrame, pad_id: int = 0, **limits) -> DataFrame:
    """As batches() for rows (doc_id, ids: array of token ids, null: none) of any tokenizer; column ids holds the batch's rows, each filled up to padded with pad_id."""
    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    rows = written(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens")), "tokens")
    placed = _filled(assign(rows.select("doc_id", "n_tokens"), **limits), rows, "ids")
    full = placed.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), (F.col("padded") - F.col("n_tokens")).cast("int"))))
    return _batched(full, "ids", "ids")
