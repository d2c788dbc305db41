"""Joins of words, boxes and predictions. All join on (docid, page) first, so each plans as a hash or merge join with the geometry as the residual."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions import geometry as g

PAGE = ["docid", "page"]
SHORT = ("l", "t", "r", "b")


def union_of_words(spans: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and left, top, right, bottom, text of the words that spans.word_ids (array) names; unknown ids are ignored, spans without any known are left out.

    Words are in order of their numbers.
    """
    ids = spans.select(*PAGE, *(k for k in keys if k not in PAGE), F.explode("word_ids").alias("word_id"))
    return box_of(ids.join(words, [*PAGE, "word_id"]), [*dict.fromkeys([*PAGE, *keys])])


def box_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grouped by keys: the box around the rows' words, and their texts, joined by spaces in order of word_id."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), text.alias("text"))


def words_in_boxes(words: DataFrame, boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """boxes (l, t, r, b) with the words whose centre they hold, edges and margin included."""
    x, y = g.centre(g.box())
    return boxes.join(words, PAGE).where(g.holds(g.box("", SHORT), x, y, margin))


def snap_to_words(boxes: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """boxes, each with the box and text of its words, or its own where it holds none (text null)."""
    held = box_of(words_in_boxes(words, boxes), [*PAGE, *keys])
    snapped = [F.coalesce(F.col(side), F.col(s)).alias(side) for side, s in zip(g.SIDES, SHORT, strict=True)]
    return boxes.join(held, [*PAGE, *keys], "left").select(*PAGE, *keys, *snapped, "text")


def smallest_region(words: DataFrame, regions: DataFrame, default: str = "Text") -> DataFrame:
    """words with region: the label of the smallest region (l, t, r, b, label, ord) around the word's centre, the first on a tie."""
    x, y = g.centre(g.box())
    near = words.join(regions, PAGE).where(g.holds(g.box("", SHORT), x, y))
    best = near.groupBy(*PAGE, "word_id").agg(F.min_by("label", F.struct(g.area(g.box("", SHORT)), F.col("ord"))).alias("region"))
    return words.join(best, [*PAGE, "word_id"], "left").withColumn("region", F.coalesce("region", F.lit(default)))


def drop_noise(tagged: DataFrame, noise: Sequence[str] = ("Caption", "Formula", "Picture", "List-item")) -> DataFrame:
    return tagged.where(~F.coalesce(F.col("region"), F.lit("Text")).isin(list(noise)))


def _pairs(fields: DataFrame, near: Column, *more: Column) -> DataFrame:
    a, b = fields.alias("a"), fields.alias("b")
    return a.join(b, [F.col("a.docid") == F.col("b.docid"), F.col("a.page") == F.col("b.page"), F.col("a.pos") < F.col("b.pos"), near, *more])


def overlap_pairs(fields: DataFrame, share: float = 0.5, least: float = 1e-6) -> DataFrame:
    """docid, page, pos_a, pos_b of page-level fields of different types that overlap by share of the smaller or more; boxes under least are left out."""
    real = fields.where(F.col("li").isNull() & (g.area(g.box("", SHORT)) >= least))
    near = g.overlap_fraction(g.box("a.", SHORT), g.box("b.", SHORT)) >= share
    return _pairs(real, near, F.col("a.fieldtype") != F.col("b.fieldtype")).select(F.col("a.docid").alias("docid"), F.col("a.page").alias("page"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"))


def demote_overlaps(fields: DataFrame, factor: float = 0.5, **limits) -> DataFrame:
    """fields with the score times factor where the field is in an overlapping pair."""
    pairs = overlap_pairs(fields, **limits)
    hit = pairs.select("docid", "page", F.explode(F.array("pos_a", "pos_b")).alias("pos")).distinct().withColumn("hit", F.lit(True))
    return fields.join(hit, ["docid", "page", "pos"], "left").withColumn("score", F.when(F.col("hit"), F.col("score") * factor).otherwise(F.col("score"))).drop("hit")


def conflict_pairs(fields: DataFrame, ambiguous: Sequence[tuple[str, str]], gap: float = 0.2, share: float = 0.3) -> DataFrame:
    """docid, page, pos_a, pos_b, pair of fields whose types are an ambiguous pair, that overlap, and whose scores are less than gap apart."""
    spark = fields.sparkSession
    known = spark.createDataFrame([(min(p), max(p)) for p in ambiguous], "one string, two string")
    near = (g.overlap_fraction(g.box("a.", SHORT), g.box("b.", SHORT)) >= share) & (F.abs(F.col("a.score") - F.col("b.score")) < gap)
    found = _pairs(fields, near)
    types = (F.least("a.fieldtype", "b.fieldtype") == F.col("one")) & (F.greatest("a.fieldtype", "b.fieldtype") == F.col("two"))
    return found.join(F.broadcast(known), types).select(F.col("a.docid").alias("docid"), F.col("a.page").alias("page"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.concat_ws("|", "one", "two").alias("pair"))


def conflict_stats(pairs: DataFrame, resolved: Column) -> DataFrame:
    return pairs.groupBy("pair").agg(F.count("*").alias("triggered"), F.count_if(resolved).alias("resolved"))


def drop_losers(fields: DataFrame, decisions: DataFrame, gap: float = 0.15) -> DataFrame:
    """fields without those that lose a decided pair (docid, page, pos_a, pos_b, score_a, score_b): scores at least gap apart decide."""
    apart = F.abs(F.col("score_a") - F.col("score_b")) >= gap
    lost = decisions.where(apart).select("docid", "page", F.when(F.col("score_a") < F.col("score_b"), F.col("pos_a")).otherwise(F.col("pos_b")).alias("pos")).distinct()
    return fields.join(lost, ["docid", "page", "pos"], "left_anti")


def best_iou(new: DataFrame, old: DataFrame, least: float = 0.0) -> DataFrame:
    """new with the best iou above least with old's fields of its type on its page, and that field's pos (first on a tie), else nulls."""
    a, b = new.alias("a"), old.alias("b")
    value = g.iou(g.box("a.", SHORT), g.box("b.", SHORT))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("docid", "fieldtype", "page")]
    names = ["docid", "fieldtype", "page", "pos"]
    found = a.join(b, same).select(*(F.col(f"a.{c}").alias(c) for c in names), value.alias("iou"), F.col("b.pos").alias("old_pos")).where(F.col("iou") > least)
    best = found.groupBy(*names).agg(F.max(F.struct("iou", -F.col("old_pos"))).alias("x")).select(*names, "x.iou", (-F.col("x.col2")).alias("old_pos"))
    return new.select(names).join(best, names, "left")


def without_overlap(new: DataFrame, old: DataFrame, threshold: float = 0.01) -> DataFrame:
    """new without fields that overlap one of old's of the same type and page by more than threshold."""
    a, b = new.alias("a"), old.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("docid", "fieldtype", "page")]
    return a.join(b, [*same, g.iou(g.box("a.", SHORT), g.box("b.", SHORT)) > threshold], "left_anti")


def missing_types(docs: DataFrame, prior: DataFrame, fields: DataFrame) -> DataFrame:
    """docid, fieldtype that the document's cluster expects and fields lacks."""
    return docs.join(prior, "cluster").select("docid", "fieldtype").join(fields.select("docid", "fieldtype"), ["docid", "fieldtype"], "left_anti")


def few_shot(docs: DataFrame, train: DataFrame, most: int = 1, override: DataFrame | None = None) -> DataFrame:
    """docid, example: the first most documents of train (docid, cluster, ord) in each document's cluster; override (docid, cluster) comes first."""
    if override is not None:
        other = override.select("docid", F.col("cluster").alias("other"))
        docs = docs.join(other, "docid", "left").withColumn("cluster", F.coalesce("other", "cluster")).drop("other")
    first = train.withColumn("n", F.row_number().over(W.partitionBy("cluster").orderBy("ord"))).where(F.col("n") <= most)
    return docs.select("docid", "cluster").join(first.select("cluster", F.col("docid").alias("example"), "n"), "cluster").select("docid", "example", "n")


def field_few_shot(train: DataFrame, most: int = 3) -> DataFrame:
    """cluster, fieldtype, example, text: the first most documents of each cluster with the type, and the type's first field in each."""
    one = train.withColumn("k", F.row_number().over(W.partitionBy("docid", "fieldtype").orderBy("ord"))).where("k = 1").drop("k")
    n = F.row_number().over(W.partitionBy("cluster", "fieldtype").orderBy("ord", "docid"))
    return one.withColumn("n", n).where(F.col("n") <= most).select("cluster", "fieldtype", F.col("docid").alias("example"), "text", "n")


def no_match(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs whose cluster no training document has, or that have none."""
    return docs.join(train.select("cluster").distinct(), "cluster", "left_anti")


def directional(labels: DataFrame, words: DataFrame, reach: float = 0.2, row: float = 0.03, column: float = 0.30, most: int = 3) -> DataFrame:
    """For each label (docid, page, label_id, l, t, r, b) the most nearest words to its right, or below it; a word may come in both ways.

    Right: its left edge is at most reach past the label's right, and the tops are at most row apart. Below: its top is at most reach under the
    label's bottom, and the left edges are at most column apart. Score 0.75 - 2 * distance, at least 0.1.
    """
    both = labels.join(words, PAGE)
    right, below = F.col("left") - F.col("r"), F.col("top") - F.col("b")
    ways = F.array(
        F.when(right.between(0, reach) & (F.abs(F.col("top") - F.col("t")) <= row), F.struct(right.alias("dist"), F.lit(0).alias("way"))),
        F.when(below.between(0, reach) & (F.abs(F.col("left") - F.col("l")) <= column), F.struct(below.alias("dist"), F.lit(1).alias("way"))),
    )
    near = both.withColumn("x", F.explode(F.array_compact(ways))).select(*PAGE, "label_id", "word_id", "text", "x.dist", "x.way")
    rank = F.row_number().over(W.partitionBy(*PAGE, "label_id").orderBy("dist", "word_id", "way"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("score", F.greatest(F.lit(0.1), 0.75 - 2 * F.col("dist")))


SURROUNDINGS = "left_text string, right_text string, above_text string, below_text string, label string, dist double"
#: Pairs of a span and a word that a task compares at a time.
PAIRS = 1 << 21
PAGES = 500


def surroundings(spans: DataFrame, words: DataFrame, vocabulary: Sequence[str], row: float = 0.045, most: float = 2.0) -> DataFrame:
    """docid, page, span_id and what stands around each span (docid, page, span_id, l, t, r, b, word_ids): the texts of the nearest words to its left, right, above and below, "" where there is none, and the nearest word of the vocabulary with the distance of centres (most where there is none, and at most that).

    A word is on the span's row if their middles are at most row apart in height. On the row, left of the span are words whose middle is left of its
    left edge, nearest by the gap between edges; right, above and below likewise, these two off the row. The first word is taken on a tie; a span's own
    words don't count. A page's words and spans are arrays in one row, and a task compares them as matrices, PAIRS at a time.
    """
    cols = ("word_id", "text", "left", "top", "right", "bottom")
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x")).select(*PAGE, *(F.col("x")[k].alias(k) for k in cols))
    names = ("span_id", *SHORT, "word_ids")
    mine = spans.groupBy(*PAGE).agg(F.collect_list(F.struct(*names)).alias("x")).select(*PAGE, *(F.col("x")[k].alias(f"{k}_") for k in names))
    known = frozenset(vocabulary)

    def work(batches) -> Iterator:
        for batch in batches:
            yield from (_around(page, known, row, most) for page in batch.itertuples(index=False))

    kind = f"docid {spans.schema['docid'].dataType.simpleString()}, page int, span_id int, {SURROUNDINGS}"
    return mine.join(pages, PAGE).mapInPandas(work, kind)


def _around(page, known: frozenset[str], row: float, most: float):
    text = np.append(np.asarray(page.text, object), "")  # the last stands for none
    left, top, right, bottom = (np.asarray(x, float) for x in (page.left, page.top, page.right, page.bottom))
    x, y, ids = (left + right) / 2, (top + bottom) / 2, np.asarray(page.word_id)
    clean = np.array([str(t).strip().lower() for t in page.text], object)
    said = np.array([c in known for c in clean], bool)
    l, t, r, b = (np.asarray(v, float)[:, None] for v in (page.l_, page.t_, page.r_, page.b_))
    out: dict[str, list] = {n.split()[0]: [] for n in SURROUNDINGS.split(", ")}
    step = max(1, PAIRS // max(len(ids), 1))
    for k in range(0, len(l), step):
        at = slice(k, k + step)
        own = np.array([np.isin(ids, w) for w in page.word_ids_[at]]).reshape(-1, len(ids))
        level = np.abs(y - (t[at] + b[at]) / 2) <= row
        cases = {"left_text": (level & (x < l[at]), l[at] - right), "right_text": (level & (x > r[at]), left - r[at]), "above_text": (~level & (y < t[at]), t[at] - bottom), "below_text": (~level & (y > b[at]), top - b[at])}
        for name, (test, gap) in cases.items():
            gap = np.where(test & ~own, gap, np.inf)
            first = gap.argmin(axis=1)
            out[name] += text[np.where(np.isfinite(gap.min(axis=1)), first, len(ids))].tolist()
        dist = np.where(said & ~own, np.sqrt((x - (l[at] + r[at]) / 2) ** 2 + (y - (t[at] + b[at]) / 2) ** 2), np.inf)
        first, least = dist.argmin(axis=1), dist.min(axis=1)
        out["label"] += np.where(np.isfinite(least), clean[first], "").tolist()
        out["dist"] += np.minimum(least, most).tolist()
    return pd.DataFrame({"docid": page.docid, "page": page.page, "span_id": np.asarray(page.span_id_), **out})


def neighbours(spans: DataFrame, words: DataFrame, row: float = 0.045) -> DataFrame:
    """docid, page, span_id, left_text, right_text, above_text, below_text of surroundings()."""
    return surroundings(spans, words, (), row).drop("label", "dist")


def nearest_label(spans: DataFrame, words: DataFrame, vocabulary: Sequence[str], most: float = 2.0) -> DataFrame:
    """docid, page, span_id, label, dist of surroundings(). Spans without l, t, r, b get the box of their words; then those without any known word are left out.

    A page's words and spans are arrays in one row; a task takes PAGES of them at once and meets spans with the vocabulary's words alone, PAIRS at a time.
    """
    cols = ("word_id", "text", "left", "top", "right", "bottom")
    names = ("span_id", "word_ids", *(SHORT if "l" in spans.columns else ()))
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x")).select(*PAGE, *(F.col("x")[k].alias(k) for k in cols))
    mine = spans.groupBy(*PAGE).agg(F.collect_list(F.struct(*names)).alias("x")).select(*PAGE, *(F.col("x")[k].alias(f"{k}_") for k in names))
    known = frozenset(vocabulary)

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, PAGES):
                yield _labelled(b.slice(k, PAGES), known, most)

    both = mine.join(pages, PAGE)
    kind = f"docid {both.schema['docid'].dataType.simpleString()}, page {both.schema['page'].dataType.simpleString()}, span_id {spans.schema['span_id'].dataType.simpleString()}, label string, dist double"
    return both.mapInArrow(work, kind)


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1]."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _labelled(batch: pa.RecordBatch, known: frozenset[str], most: float) -> pa.RecordBatch:
    flat = lambda c: batch.column(c).flatten()
    number = lambda c: flat(c).to_numpy(zero_copy_only=False).astype(float)
    left, top, right, bottom = map(number, ("left", "top", "right", "bottom"))
    word_page = np.repeat(np.arange(batch.num_rows), _sizes(batch.column("word_id")))
    span_page = np.repeat(np.arange(batch.num_rows), _sizes(batch.column("span_id_")))
    # a word's key: its page and number, in the order the words have
    key = lambda page, ids: (page << 32) + ids.to_numpy(zero_copy_only=False).astype(np.int64) + (1 << 31)
    words, own_lists = key(word_page, flat("word_id")), flat("word_ids_")
    own_ids = own_lists.flatten()
    own_span = np.repeat(np.arange(len(span_page)), _sizes(own_lists))
    valid = own_ids.is_valid().to_numpy(zero_copy_only=False)
    own_span, own = own_span[valid], key(span_page[own_span[valid]], own_ids.filter(pa.array(valid)))
    kept = np.ones(len(span_page), bool)
    if "l_" in batch.schema.names:
        l, t, r, b = (number(f"{c}_") for c in SHORT)
    else:
        low, high = (np.searchsorted(words, own, side) for side in ("left", "right"))
        of, held = np.repeat(own_span, high - low), _places(low, high - low)
        kept = np.bincount(of, minlength=len(span_page)) > 0
        begins = np.concatenate(([True], of[1:] != of[:-1])).nonzero()[0] if len(of) else np.zeros(0, np.int64)
        l, t, r, b = (np.full(len(span_page), np.nan) for _ in SHORT)
        for side, values, least in ((l, left, np.minimum), (t, top, np.minimum), (r, right, np.maximum), (b, bottom, np.maximum)):
            side[kept] = least.reduceat(values[held], begins) if len(of) else 0
    spelt = flat("text").dictionary_encode(null_encoding="encode")
    clean = pa.array([(x or "").strip().lower() for x in spelt.dictionary.to_pylist()], pa.string())
    said = np.array([x.as_py() in known for x in clean], bool)
    spelling = spelt.indices.to_numpy(zero_copy_only=False)
    hits = (said[spelling] if len(said) else np.zeros(0, bool)).nonzero()[0]
    x, y = (left[hits] + right[hits]) / 2, (top[hits] + bottom[hits]) / 2
    first, last = (np.searchsorted(word_page[hits], span_page, side) for side in ("left", "right"))
    count = last - first
    nearest, dist = np.full(len(span_page), -1), np.full(len(span_page), np.inf)
    with_hits = ((count > 0) & kept).nonzero()[0]
    ends = np.cumsum(count[with_hits])
    own_low, own_high = (np.searchsorted(words[hits], own, side) for side in ("left", "right"))
    i = 0
    while i < len(with_hits):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        some = with_hits[i:j]
        n = count[some]
        begins, hit, span = np.cumsum(n) - n, _places(first[some], n), np.repeat(some, n)
        away = np.sqrt((x[hit] - (l[span] + r[span]) / 2) ** 2 + (y[hit] - (t[span] + b[span]) / 2) ** 2)
        a, z = np.searchsorted(own_span, (some[0], some[-1] + 1))
        mine = (own_high[a:z] > own_low[a:z]).nonzero()[0] + a
        mine = mine[np.isin(own_span[mine], some)]
        times = own_high[mine] - own_low[mine]
        away[np.repeat(begins[np.searchsorted(some, own_span[mine])] - first[own_span[mine]], times) + _places(own_low[mine], times)] = np.inf
        dist[some] = np.minimum.reduceat(away, begins)
        nearest[some] = hit[np.minimum.reduceat(np.where(away == np.repeat(dist[some], n), np.arange(len(away)), len(away) - 1), begins)]
        i = j
    found = np.isfinite(dist)
    label = pa.array(np.where(found, spelling[hits[nearest]], -1) if len(hits) else np.full(len(dist), -1), mask=~found, type=pa.int64())
    keep = pa.array(kept)
    columns = [*(batch.column(c).take(pa.array(span_page)) for c in PAGE), flat("span_id_"), pc.fill_null(clean.take(label), ""), pa.array(np.minimum(dist, most))]
    return pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], [*PAGE, "span_id", "label", "dist"])


def replace_by_iou(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """old, with a new field's box and score in place of those of the field it overlaps best by threshold or more."""
    hits = best_iou(new, old, threshold - 1e-12).where("iou is not null").groupBy("docid", "fieldtype", "page", "old_pos").agg(F.max_by("pos", F.struct("iou", -F.col("pos"))).alias("new_pos"))
    value = new.select("docid", "fieldtype", "page", F.col("pos").alias("new_pos"), *(F.col(c).alias(f"new_{c}") for c in (*SHORT, "score")))
    found = hits.join(value, ["docid", "fieldtype", "page", "new_pos"]).drop("new_pos").withColumnRenamed("old_pos", "pos")
    out = old.join(found, ["docid", "fieldtype", "page", "pos"], "left")
    return out.select("docid", "fieldtype", "page", "pos", *(F.coalesce(f"new_{c}", c).alias(c) for c in (*SHORT, "score")))


def fall_back(better: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """better, and base where better has nothing for the keys."""
    return better.unionByName(base.join(better.select(*keys).distinct(), list(keys), "left_anti").select(better.columns))


def first_page(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the pages where something was found, the first."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("page"))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank")


def occurrences(predicted: DataFrame, found: DataFrame) -> DataFrame:
    """The nth predicted (docid, fieldtype, text, ord) with the nth found (docid, fieldtype, text, place); predictions past the last are dropped."""
    keys = ["docid", "fieldtype", "text"]
    a = predicted.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("ord")))
    b = found.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("place")))
    return a.join(b, [*keys, "n"])


def cells_to_fields(cells: DataFrame, columns: DataFrame, header_row: int = 0, score: float = 0.9) -> DataFrame:
    """Cells (docid, page, table_id, row, col, text) below the header whose column has a type (docid, page, table_id, col, fieldtype), with their row's id."""
    rows = cells.where(F.col("row") > header_row).join(columns.where("fieldtype is not null"), ["docid", "page", "table_id", "col"])
    return rows.withColumn("line_item_id", F.col("page") * 10000 + F.col("table_id") * 100 + F.col("row")).withColumn("score", F.lit(score))


def cells_on_words(cells: DataFrame, columns: DataFrame, words: DataFrame, header_row: int = 0, score: float = 0.9) -> DataFrame:
    """cells_to_fields() of cells with a box (l, t, r, b), each with the box and text of the words whose centre it holds; cells that hold none are dropped."""
    fields = cells_to_fields(cells, columns, header_row, score)
    keys = [*PAGE, "table_id", "row", "col"]
    held = box_of(words_in_boxes(words, fields.select(*keys, *SHORT)), keys)
    return fields.drop("text", *SHORT).join(held, keys)
