"""Finding texts in runs of words, and runs that hold nothing."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from pagefold.functions import pages as pg
from pagefold.functions import text as t
from pagefold.operators import rows as r

PAGE = ["docid", "page"]


def exact_windows(queries: DataFrame, words: DataFrame, most: int = 20) -> DataFrame:
    """docid, page, qid, start, n of the first, then shortest run of words that equals each query (docid, page, qid, query), white space apart.

    Runs are matched on their text without white space, an equi-join, so only equal ones meet.
    """
    runs = r.windows(words, most).select(*PAGE, "start", "n", "compact")
    wanted = queries.withColumn("compact", t.compact(F.col("query"))).where(F.col("compact") != "")
    return wanted.join(runs, [*PAGE, "compact"]).groupBy(*PAGE, "qid").agg(F.min(F.struct("start", "n")).alias("x")).select(*PAGE, "qid", "x.*")


def digit_windows(queries: DataFrame, words: DataFrame, most: int = 20) -> DataFrame:
    """As exact_windows by the digits alone; queries without digits match nothing."""
    runs = r.windows(words, most).withColumn("digits", t.digits_only(F.col("compact"))).where(F.col("digits") != "")
    wanted = queries.withColumn("digits", t.digits_only(F.col("query")))
    return wanted.join(runs, [*PAGE, "digits"]).groupBy(*PAGE, "qid").agg(F.min(F.struct("start", "n")).alias("x")).select(*PAGE, "qid", "x.*")


def find_span(query: str, words: Sequence[str], least: float = 0.75) -> tuple[int, int, float] | None:
    """(first, last, ratio) of the run of the query's number of words, two more or fewer, most like it: the shortest, then leftmost of equals; None under least."""
    return Page(words).find(query, least)


class Page:
    """A page's words, with how often letters occur up to each. Letters share CLASSES counts, so counts in common are at least the letters that can match, and a run whose counts are too few for a better ratio is passed over; the others get the ratio itself."""

    CLASSES = 64

    def __init__(self, words: Sequence[str]):
        self.words, self.firsts = list(words), {}

    @cached_property
    def size(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum([len(w) for w in self.words], dtype=np.int64)))

    @cached_property
    def counts(self) -> np.ndarray:
        codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") % self.CLASSES for w in self.words]
        place = np.repeat(np.arange(len(codes)), np.diff(self.size))
        counts = np.zeros((self.CLASSES, len(codes) + 1), np.int32)
        np.add.at(counts, (np.concatenate(codes) if codes else np.zeros(0, np.int64), place + 1), 1)
        return counts.cumsum(axis=1, dtype=np.int32)

    def bounds(self, query: np.ndarray, n: int) -> np.ndarray:
        """For each run of n words, at least its ratio to a text with the letter counts query."""
        have = np.zeros(len(self.words) - n + 1, np.int64)
        for c in np.flatnonzero(query):
            spaces = n - 1 if c == ord(" ") % self.CLASSES else 0
            have += np.minimum(self.counts[c, n:] - self.counts[c, :-n] + spaces, query[c])
        return 2.0 * have / (query.sum() + self.size[n:] - self.size[:-n] + n - 1)

    def first(self, query: str, n: int) -> int | None:
        """Where the first run of n words stands that is the query."""
        if n not in self.firsts:
            runs = self.words if n == 1 else map(" ".join, zip(*(self.words[k:] for k in range(n)), strict=False))
            self.firsts[n] = {}
            for i, run in enumerate(runs):
                self.firsts[n].setdefault(run, i)
        return self.firsts[n].get(query)

    def find(self, query: str, least: float) -> tuple[int, int, float] | None:
        best, best_ratio, q = None, least, len(query.split())
        # nothing is likelier than the text itself, and no other text is as likely; from 200 letters on difflib may leave out letters
        if query and len(query) < 200 and least <= 1.0:
            for n in range(max(1, q - 2), min(q + 2, len(self.words)) + 1):
                if (i := self.first(query, n)) is not None:
                    return (i, i + n - 1, 1.0)
        letters = np.bincount(np.frombuffer(query.encode("utf-32-le", "surrogatepass"), "<u4") % self.CLASSES, minlength=self.CLASSES)
        for n in range(max(1, q - 2), min(q + 2, len(self.words)) + 1):
            bounds = self.bounds(letters, n)
            for i in np.flatnonzero(bounds >= best_ratio).tolist():
                if best is not None and bounds[i] <= best_ratio:
                    continue
                ratio = SequenceMatcher(None, query, " ".join(self.words[i : i + n])).ratio()
                if ratio > best_ratio or best is None and ratio == best_ratio:
                    best, best_ratio = (i, i + n - 1, ratio), ratio
        return best


def likeness(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(), of short texts by searching for parts of one in the other."""
    if len(b) >= 200:  # from there on difflib may leave out letters
        return SequenceMatcher(None, a, b).ratio()
    same, parts = 0, [(a, b)]
    while parts:
        x, y = parts.pop()
        at = size = i = 0
        while i + size < len(x):
            if x[i : i + size + 1] in y:
                at, size = i, size + 1
            else:
                i += 1
        if size:
            same, j = same + size, y.index(x[at : at + size])
            if at and j:
                parts.append((x[:at], y[:j]))
            if at + size < len(x) and j + size < len(y):
                parts.append((x[at + size :], y[j + size :]))
    return 2.0 * same / (len(a) + len(b)) if a or b else 1.0


def _coded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in classes of Page.CLASSES, text after text, and where each text begins."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
    return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") % Page.CLASSES).astype(np.uint8), ends


def _bits(letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text a bit for each class of letters that it has, and for each that it has twice; spaces apart."""
    n = len(ends) - 1
    text = np.repeat(np.arange(n), np.diff(ends))
    kept = letters != 32
    counts = np.bincount(text[kept] * Page.CLASSES + letters[kept], minlength=n * Page.CLASSES).reshape(n, Page.CLASSES)
    bit = np.uint64(1) << np.arange(Page.CLASSES, dtype=np.uint64)
    return ((counts > 0) * bit).sum(axis=1, dtype=np.uint64), ((counts > 1) * bit).sum(axis=1, dtype=np.uint64)


def find_in_pages(texts: Sequence[str], spelling: np.ndarray, page: np.ndarray, queries: Sequence[str], on: np.ndarray, least: float = 0.75) -> list[tuple[int, int, float] | None]:
    """find_span of each query among the words of its page (spelling: the place of each word's text; page: that of each word, ascending; on: that of each query), first and last as places among the words; nothing for an empty query.

    A query that stands on its page is looked up. For others all runs are met as arrays: those whose lengths and letters allow least are held by the longest
    common sequence, which is at least what likeness counts, and the likeliest by that are compared first, until no other can be as like.
    """
    out: list = [None] * len(queries)
    if not len(spelling) or not len(queries):
        return out
    words = list(map(texts.__getitem__, spelling.tolist()))
    text = " ".join(words)
    letters = _coded([text])[0]
    starts = np.concatenate(([0], np.cumsum(np.array(list(map(len, texts)), np.int64)[spelling] + 1)))
    low, high = (np.searchsorted(page, on, side) for side in ("left", "right"))
    number = np.array([len(q.split()) for q in queries], np.int64)
    begins, places = starts.tolist(), {}
    rest = []
    for k, (q, p, a, z) in enumerate(zip(queries, on.tolist(), low.tolist(), high.tolist(), strict=True)):
        if not q or a == z or (p, q) in places:
            continue
        places[p, q] = k
        best = None
        if len(q) < 200 and least <= 1.0:
            first, end = begins[a], begins[z] - 1
            at = text.find(q, first, end)
            while at >= 0:
                i = bisect_left(begins, at)
                j = bisect_left(begins, at + len(q) + 1)
                if begins[i] == at and begins[j] == at + len(q) + 1 and max(1, number[k] - 2) <= j - i <= number[k] + 2 and (best is None or j - i < best[0]):
                    best = (j - i, i)
                at = text.find(q, at + 1, end)
        if best is None:
            rest.append(k)
        else:
            out[k] = (best[1], best[1] + best[0] - 1, 1.0)
    some = np.array(rest, np.int64)
    if len(some):
        for k, found in zip(rest, _likest(texts, spelling, words, starts, letters, [queries[k] for k in rest], low[some], high[some], number[some], least), strict=True):
            out[k] = found
    return [out[places[p, q]] if (p, q) in places else None for q, p in zip(queries, on.tolist(), strict=True)]


def _likest(texts, spelling, words, starts, letters, queries, low, high, number, least) -> list[tuple[int, int, float] | None]:
    coded, ends = _coded(queries)
    long = np.diff(ends)
    once, twice = _bits(coded, ends)
    one, two = (x[spelling] for x in _bits(*_coded(texts)))
    # of each query and letter the places it has there, for the longest common sequence
    where = np.zeros((len(queries), Page.CLASSES), np.uint64)
    short = np.repeat(long <= 64, long)
    at = np.arange(len(coded)) - np.repeat(ends[:-1], long)
    np.bitwise_or.at(where, (np.repeat(np.arange(len(queries)), long)[short], coded[short]), np.uint64(1) << at[short].astype(np.uint64))
    where = where.ravel()
    # the shortest and longest texts that can be as like
    long = long.astype(np.int32)
    shortest, longest = (np.minimum(x, np.iinfo(np.int32).max).astype(np.int32) for x in (np.ceil((least - 1e-9) / 2 * long / (1 - (least - 1e-9) / 2)), long * (2 / max(least - 1e-9, 1e-9) - 1)))
    found: list[list] = [[] for _ in queries]
    run_one, run_two = one, two
    for n in range(1, int((number + 2).max()) + 1):
        if n > 1:  # runs of n words: the one of n - 1 and the word after
            run_two = run_two[:-1] | two[n - 1 :] | (run_one[:-1] & one[n - 1 :])
            run_one = run_one[:-1] | one[n - 1 :]
            if not len(run_one):
                break
        run_long = (starts[n:] - 1 - starts[:-n]).astype(np.int32)
        mine = ((np.maximum(number - 2, 1) <= n) & (n <= number + 2)).nonzero()[0]
        count = np.maximum(high[mine] - low[mine] - n + 1, 0)
        for part in pg.slices(count, pg.PAIRS):
            query, first = np.repeat(mine[part], count[part]), pg.places(low[mine[part]], count[part])
            length = run_long[first]
            fits = ((length >= shortest[query]) & (length <= longest[query])).nonzero()[0]
            query, first, length = query[fits], first[fits], length[fits]
            asked, there = once[query], run_one[first]
            own, its = long[query] - np.bitwise_count(asked & ~there), length - np.bitwise_count(there & ~asked)
            need = (least - 1e-9) / 2 * (long[query] + length)
            fits = (np.minimum(own, its) >= need).nonzero()[0]
            query, first, length, own, its, need = (x[fits] for x in (query, first, length, own, its, need))
            asked, there = twice[query], run_two[first]
            have = np.minimum(own - np.bitwise_count(asked & ~there), its - np.bitwise_count(there & ~asked))
            fits = (have >= need).nonzero()[0]
            fits = fits[np.argsort(-length[fits], kind="stable")]
            query, first, length, have = query[fits], first[fits], length[fits], have[fits]
            state, begin, table = np.full(len(query), ~np.uint64(0)), starts[first], query * Page.CLASSES
            active = np.searchsorted(-length, -np.arange(length.max(initial=0)), "left")
            for k, m in enumerate(active.tolist()):
                s = state[:m]
                u = s & where[table[:m] + letters[begin[:m] + k]]
                state[:m] = (s + u) | (s - u)
            have = np.where(long[query] <= 64, np.bitwise_count(~state), have)
            bound = 2.0 * have / (long[query] + length)
            fits = bound >= least - 1e-9
            for q, *x in zip(query[fits].tolist(), (-bound[fits]).tolist(), first[fits].tolist(), strict=True):
                found[q].append((x[0], n, x[1]))
    out = []
    for q, some in zip(queries, found, strict=True):
        best, best_ratio = None, least
        for bound, n, i in sorted(some):
            if -bound < best_ratio - 1e-9:
                break
            ratio = likeness(q, " ".join(words[i : i + n]))
            if ratio > best_ratio or ratio == best_ratio and (best is None or (n, i) < best):
                best, best_ratio = (n, i), ratio
        out.append(best and (best[1], best[1] + best[0] - 1, best_ratio))
    return out


def find_spans(queries: DataFrame, words: DataFrame, least: float = 0.75) -> DataFrame:
    """docid, page, qid, first, last, ratio of find_span on normal texts for queries (docid, page, qid, query); a page's words and queries are one group."""
    pages = words.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "text"))), lambda x: x["text"]).alias("ws"))
    wanted = queries.where("query is not null").groupBy(*PAGE).agg(F.collect_list(F.struct("qid", "query")).alias("qs"))
    both = wanted.join(pages, PAGE).select(*PAGE, F.col("qs.qid").alias("qids"), F.col("qs.query").alias("qs"), "ws")

    def search(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for part in pg.slices(b.ws.str.len().to_numpy(np.int64), pg.WORDS):
                some = b.iloc[part]
                count, asked = (x.str.len().to_numpy(np.int64) for x in (some.ws, some.qs))
                words, spelling = np.unique(np.array([t.aligned(w) or "" for ws in some.ws for w in ws], object), return_inverse=True)
                begins, on = np.cumsum(count) - count, np.repeat(np.arange(len(some)), asked)
                found = find_in_pages(words.tolist(), spelling, np.repeat(np.arange(len(some)), count), [t.aligned(q) for qs in some.qs for q in qs], on, least)
                keys = zip(some.docid.to_numpy()[on], some.page.to_numpy()[on], (q for qs in some.qids for q in qs), begins[on].tolist(), found, strict=True)
                out += [(d, p, qid, f[0] - begin, f[1] - begin, f[2]) for d, p, qid, begin, f in keys if f]
            yield pd.DataFrame(out, columns=["docid", "page", "qid", "first", "last", "ratio"])

    kind = f"docid {queries.schema['docid'].dataType.simpleString()}, page int, qid long, first int, last int, ratio double"
    return both.mapInPandas(search, kind)


def find_inside(values: DataFrame, words: DataFrame, keys: Sequence[str], least: float = 0.75) -> DataFrame:
    """keys, word_ids: the run of each value's own words (keys, word_id, text) most like it (values: keys, value), as find_span has it."""
    some = F.transform(F.array_sort(F.collect_list(F.struct("word_id", "normal"))), lambda x: x)
    own = words.withColumn("normal", t.align_text("text")).groupBy(*keys).agg(some.alias("ws"))
    both = values.select(*keys, t.align_text("value").alias("normal")).join(own, list(keys)).where("normal <> ''").select(*keys, "normal", "ws")

    def search(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if f := Page([w["normal"] for w in row.ws]).find(row.normal, least):
                    out.append((*(getattr(row, k) for k in keys), [int(w["word_id"]) for w in row.ws[f[0] : f[1] + 1]]))
            yield pd.DataFrame(out, columns=[*keys, "word_ids"])

    kind = StructType([*(both.schema[k] for k in keys), StructField("word_ids", ArrayType(IntegerType()))])
    return both.mapInPandas(search, kind)


def negative_spans(positives: DataFrame, words: DataFrame, per_page: int = 5, most: int = 4) -> DataFrame:
    """docid, page, start, n: the per_page runs of 1..most words of each page without a positive word (docid, page, word_id) that come first by a hash; the same whenever it runs."""
    taken = positives.groupBy(*PAGE).agg(F.collect_set("word_id").alias("taken"))
    runs = r.windows(words, most).select(*PAGE, "start", "n").join(taken, PAGE, "left")
    free = ~F.coalesce(F.arrays_overlap("taken", F.sequence("start", F.col("start") + F.col("n") - 1)), F.lit(False))
    rank = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.xxhash64(F.lit(42), *PAGE, "start", "n"), "start", "n"))
    return runs.where(free).withColumn("rank", rank).where(F.col("rank") <= per_page).drop("taken", "rank")
