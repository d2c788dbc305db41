"""Rows of words, reading orders, windows and runs. A page's words are one array, in one shuffle by (docid, page)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["docid", "page"]


def page_arrays(words: DataFrame, order: Sequence[Column], columns: Sequence[str] = ("word_id", "text", "left", "top", "right", "bottom")) -> DataFrame:
    """docid, page, words: the page's words as structs, in order."""
    lead = [o.alias(f"o{k}") for k, o in enumerate(order)]
    sorted_ = F.array_sort(F.collect_list(F.struct(*lead, "word_id", F.struct(*columns).alias("w"))))
    return words.groupBy(*PAGE).agg(F.transform(sorted_, lambda x: x["w"]).alias("words"))


def anchored(words: Column, tolerance: float = 0.012) -> Column:
    """Row numbers, from 0, of words in order of top and left: a word is in the row whose first word's top is at most tolerance away, else begins the next."""
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).cast("double").alias("anchor"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        new = (s["row"] < 0) | (F.abs(w["top"] - s["anchor"]) > tolerance)
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        return F.struct(row.alias("row"), F.when(new, w["top"]).otherwise(s["anchor"]).alias("anchor"), F.array_append(s["out"], row).alias("out"))

    return F.aggregate(words, start, step, lambda s: s["out"])


def _page_rows(tolerance: float):
    """anchored() for whole pages, from their tops in order: an Arrow batch of pages at a time, a search for each row, where a fold would copy its array for each word."""

    def rows(tops: np.ndarray) -> np.ndarray:
        out, i, row = np.empty(len(tops), np.int32), 0, 0
        while i < len(tops):
            j = int(np.searchsorted(tops, tops[i] + tolerance, "right"))
            while j < len(tops) and abs(tops[j] - tops[i]) <= tolerance:
                j += 1
            while j > i + 1 and abs(tops[j - 1] - tops[i]) > tolerance:
                j -= 1
            out[i:j] = row
            i, row = j, row + 1
        return out

    @F.arrow_udf("array<int>")
    def of(col: pa.Array) -> pa.Array:
        flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(col).to_numpy(zero_copy_only=False)])
        found = [rows(flat[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))

    return of


def row_groups(words: DataFrame, tolerance: float = 0.012) -> DataFrame:
    """words with row, the number of their row on the page."""
    pages = page_arrays(words, [F.col("top"), F.col("left")])
    tagged = pages.withColumn("rows", _page_rows(tolerance)(F.transform("words", lambda w: w["top"])))
    flat = tagged.select(*PAGE, F.inline(F.arrays_zip("words", "rows")))
    return flat.select(*PAGE, "words.*", F.col("rows").alias("row"))


def layout(rows: DataFrame, tag: Column | None = None) -> DataFrame:
    """docid, page, layout: a line for each row, "R0(y=0.100): 3:word  4:word", the words by left; with tag, a column of rows, its most common value, the first from the left on a tie."""
    parts = F.array_sort(F.collect_list(F.struct("left", "word_id", "text", F.coalesce(tag, F.lit("")).alias("tag") if tag is not None else F.lit("").alias("tag"))))
    line = rows.groupBy(*PAGE, "row").agg(F.min_by("top", F.struct("top", "left", "word_id")).alias("y"), parts.alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["word_id"].cast("string"), p["text"])), "  ")
    tags = F.transform("parts", lambda p: p["tag"])
    count = lambda t: F.size(F.filter(tags, lambda x: x == t))
    ranked = F.transform(F.array_distinct(tags), lambda t, i: F.struct(count(t).alias("n"), (-i).alias("i"), t.alias("t")))
    name = F.concat(F.lit("["), F.array_max(ranked)["t"], F.lit("] ")) if tag is not None else F.lit("")
    text = F.concat(name, F.format_string("R%d(y≈%.3f): ", "row", F.bround("y", 3)), body)
    lines = line.select(*PAGE, "row", text.alias("line"))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("layout"))


def reading_order(words: DataFrame, scale: float = 100.0, step: float | None = None) -> DataFrame:
    """words with place, from 1: by top times scale, or by step, halves to even, then left."""
    key = F.bround(F.col("top") * scale if step is None else F.col("top") / step).cast("long")
    return words.withColumn("place", F.row_number().over(W.partitionBy(*PAGE).orderBy(key, "left", "word_id")))


def windows(words: DataFrame, most: int, begins: str | None = None) -> DataFrame:
    """Every run of 1..most words in order of word_id: docid, page, start, n, spaced, compact. In arrays, so the words are shuffled once and the runs never.

    begins: a pattern that the text of a run's first four words and those after them must have, without spaces; other places make no runs.
    """
    pages = page_arrays(words, [], ("word_id", "text"))
    text = lambda i, n: F.transform(F.slice("words", i + 1, n), lambda x: x["text"])
    places = F.sequence(F.lit(0), F.size("words") - 1)
    if begins is not None:
        places = F.filter(places, lambda i: F.array_join(text(i, F.lit(4)), "").rlike(begins))
    sizes = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size("words") - i))
    runs = F.flatten(F.transform(places, lambda i: F.transform(sizes(i), lambda n: F.struct(F.get("words", i)["word_id"].alias("start"), n.alias("n"), text(i, n).alias("texts")))))
    return pages.select(*PAGE, F.inline(runs)).select(*PAGE, "start", "n", F.array_join("texts", " ").alias("spaced"), F.array_join("texts", "").alias("compact"))


def candidate_windows(words: DataFrame, most: int = 4, lines: bool = False, step: float = 0.015, apart: float = 0.045) -> DataFrame:
    """docid, page, pos (place in reading order, from 0), n, ids, spaced: runs of 1..most words in reading order. Unless lines, a run ends before the first word that is over apart higher or lower than its first."""
    pages = page_arrays(words, [F.bround(F.col("top") / step).cast("long"), F.col("left")], ("word_id", "text", "top"))

    def sizes(w: Column, i: Column) -> Column:
        near = F.slice("words", i + 1, F.lit(most))
        far = F.array_position(F.transform(near, lambda x: F.abs(x["top"] - w["top"]) > apart), True)
        return F.size(near) if lines else F.when(far > 0, far.cast("int") - 1).otherwise(F.size(near))

    run = lambda i, n: F.struct(i.alias("pos"), n.alias("n"), F.slice("words", i + 1, n).alias("run"))
    every = F.flatten(F.transform("words", lambda w, i: F.transform(F.sequence(F.lit(1), sizes(w, i)), lambda n: run(i, n))))
    flat = pages.select(*PAGE, F.inline(every))
    return flat.select(*PAGE, "pos", "n", F.transform("run", lambda w: w["word_id"]).alias("ids"), F.array_join(F.transform("run", lambda w: w["text"]), " ").alias("spaced"))


def window_totals(words: DataFrame, most: int = 4, lines: bool = False, step: float = 0.015, apart: float = 0.045) -> DataFrame:
    """docid, page, n, characters: how many runs candidate_windows() gives for each page, and the characters of their spaced texts, added up from the words' lengths without making the runs."""
    pages = page_arrays(words.withColumn("size", F.length("text")), [F.bround(F.col("top") / step).cast("long"), F.col("left")], ("size", "top"))
    part = lambda c: F.transform("words", lambda w: w[c])
    return pages.select(*PAGE, _totals(most, None if lines else apart)(part("size"), part("top")).alias("x")).select(*PAGE, "x.*")


def _totals(most: int, apart: float | None):
    @F.arrow_udf("struct<n: bigint, characters: bigint>")
    def of(sizes: pa.Array, tops: pa.Array) -> pa.Array:
        flat = sizes.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)  # a text that is null is not joined
        size, top = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), tops.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(sizes).to_numpy(zero_copy_only=False), dtype=np.int64)
        page = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        text, joined = (np.concatenate(([0], np.cumsum(x))) for x in (size, known))
        at, n, characters = np.arange(len(size)), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for k in range(1, most + 1):
            at = at[at + k <= ends[page[at]]]
            if apart is not None:
                at = at[~(np.abs(top[at + k - 1] - top[at]) > apart)]
            there = page[at]
            n += np.bincount(there, minlength=len(ends))
            made = text[at + k] - text[at] + np.maximum(joined[at + k] - joined[at] - 1, 0)
            characters += np.diff(np.concatenate(([0], np.cumsum(made)))[np.searchsorted(there, np.arange(len(ends) + 1))])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(characters)], ["n", "characters"])

    return of


def has_label(words: DataFrame, labels: Sequence[str], radius: int = 3) -> DataFrame:
    """words with labelled: whether one of labels stands in the radius words before, or after."""
    before = W.partitionBy(*PAGE).orderBy("word_id").rowsBetween(-radius, -1)
    after = W.partitionBy(*PAGE).orderBy("word_id").rowsBetween(1, radius)
    around = F.concat_ws(" ", F.collect_list(F.lower("text")).over(before), F.collect_list(F.lower("text")).over(after))
    return words.withColumn("around", around).withColumn("labelled", F.col("around").rlike("|".join(labels))).drop("around")


def longest_run(ids: Column) -> Column:
    """The longest run of consecutive numbers among ids (the first of equals), as the elements of ids in it, in their order."""
    s = F.array_sort(F.array_distinct(ids))
    keyed = F.transform(s, lambda x, i: F.struct((x - i).alias("g"), x.alias("x")))
    groups = F.transform(F.array_distinct(F.transform(keyed, lambda k: k["g"])), lambda g: F.struct(F.size(F.filter(keyed, lambda k: k["g"] == g)).alias("n"), (-g).alias("minus"), F.transform(F.filter(keyed, lambda k: k["g"] == g), lambda k: k["x"]).alias("xs")))
    return F.filter(ids, lambda x: F.array_contains(F.array_max(groups)["xs"], x))


def row_blocks(rows: DataFrame, gap: float = 0.04) -> DataFrame:
    """docid, page, first_row, n_rows, n_words of the largest block of rows of which each begins less than gap under the one before (most words, the first of equals)."""
    row = rows.groupBy(*PAGE, "row").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("n"))
    order = W.partitionBy(*PAGE).orderBy("row")
    far = F.coalesce((F.col("top") - F.lag("bottom").over(order)) >= gap, F.lit(False))
    blocks = row.withColumn("far", far).withColumn("block", F.sum(F.col("far").cast("int")).over(order)).groupBy(*PAGE, "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n_rows"), F.sum("n").alias("n_words"))
    best = F.max_by(F.struct("first_row", "n_rows", "n_words"), F.struct("n_words", -F.col("first_row")))
    return blocks.groupBy(*PAGE).agg(best.alias("x")).select(*PAGE, "x.*")


def expansions(spans: DataFrame, rows: DataFrame, radius: int = 3) -> DataFrame:
    """Candidate spans around each span (docid, page, span_id, word_ids): itself, grown both ways, to the left, to the right, its rows, and runs of its length and one more moved by -radius..radius. First of equals is kept."""
    keys = [*PAGE, "span_id"]
    last = rows.groupBy(*PAGE).agg(F.max("word_id").alias("last"))
    members = rows.groupBy(*PAGE, "row").agg(F.collect_list("word_id").alias("members"))
    own = spans.select(*keys, F.explode("word_ids").alias("word_id")).join(rows.select(*PAGE, "word_id", "row"), [*PAGE, "word_id"]).select(*keys, "row").distinct()
    level = own.join(members, [*PAGE, "row"]).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("level"))
    low, high, n = F.array_min("word_ids"), F.array_max("word_ids"), F.size("word_ids")

    def inside(a: Column, z: Column) -> Column:
        """The page's numbers from a to z: they run from 0 without a gap."""
        a, z = F.greatest(a, F.lit(0)), F.least(z, F.col("last"))
        return F.when(a <= z, F.sequence(a, F.greatest(a, z))).otherwise(F.array().cast("array<int>"))

    moved = [inside(low + k, low + k + n - 1 + more) for k in range(-radius, radius + 1) for more in (0, 1)]
    every = F.array(F.sort_array("word_ids"), inside(low - radius, high + radius), inside(low - radius, high), inside(low, high + radius), "level", *moved)
    distinct = F.array_distinct(F.filter(every, lambda c: F.size(c) > 0))
    return spans.join(last, PAGE).join(level, keys).select(*keys, F.posexplode(distinct).alias("ord", "candidate"))
