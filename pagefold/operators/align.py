"""The alignment cascade, verification of boxes, code extractors, and rules in place of scripts."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import catalog
from pagefold.functions import pages as pg
from pagefold.functions.text import aligned_all
from pagefold.functions.validators import confidence
from pagefold.operators import joins
from pagefold.operators import rows as r
from pagefold.operators import spans as sp

PAGE = ["docid", "page"]
DIGITS_FIRST = frozenset(catalog.FAMILIES["amount"] + catalog.FAMILIES["date"])
ADDRESSES = frozenset(t for t in catalog.KILE if t.endswith("_address"))
MOST, NORMAL, DIGITS, ALIKE, DIGITS_ALIKE, FORMAT, FORMAT_ALIKE, LINES = 20, 0.95, 0.9, 0.85, 0.88, 0.8, 0.7, 0.95


@dataclass(frozen=True)
class Found:
    """Places of words in reading order, how sure, and by which step."""

    places: tuple[int, ...]
    confidence: float
    method: str


@lru_cache(maxsize=1 << 16)
def _nfkc(s: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", s).lower().split())


@lru_cache(maxsize=1 << 16)
def _code(s: str) -> str:
    return _nfkc(s).replace(" ", "").translate(str.maketrans("ol", "01"))


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _places(parts: Sequence[str]) -> dict[str, list[int]]:
    """Where each part stands."""
    out: dict[str, list[int]] = {}
    for i, p in enumerate(parts):
        out.setdefault(p, []).append(i)
    return out


def _equal(parts: Sequence[str], want: str, most: int, places: dict[str, list[int]] | None = None) -> tuple[int, ...] | None:
    """The first, then shortest run of parts that give want one after another; a run ends where it is no longer a beginning of want. With _places(parts) only runs whose first part is a beginning are tried."""
    starts = range(len(parts)) if places is None or len(want) > 500 else sorted(i for k in range(len(want) + 1) for i in places.get(want[:k], ()))
    for i in starts:
        s = ""
        for k in range(i, min(i + most, len(parts))):
            s += parts[k]
            if s == want:
                return tuple(range(i, k + 1))
            if not want.startswith(s):
                break
    return None


class Likest:
    """The run of words most like a text, the first of equals. difflib's quick bounds pass over runs that can't be better."""

    def __init__(self, query: str, least: float):
        self.matcher = SequenceMatcher()
        self.matcher.set_seq2(query)
        self.best, self.run = math.nextafter(least, 0), None

    def offer(self, texts: Iterable[str], run: tuple[int, int], weight: float = 1.0) -> None:
        m = self.matcher
        for text in texts:
            m.set_seq1(text)
            if m.real_quick_ratio() * weight > self.best and m.quick_ratio() * weight > self.best and (r := m.ratio() * weight) > self.best:
                self.best, self.run = r, run

    def found(self, factor: float, method: str) -> Found | None:
        return None if self.run is None else Found(tuple(range(*self.run)), self.best * factor, method)


class PageWords:
    """A page's texts in reading order, with the forms the steps compare, made when first needed."""

    def __init__(self, texts: Sequence[str], most: int = MOST):
        self.texts, self.most = list(texts), most

    @cached_property
    def bare(self) -> list[str]:
        return ["".join(t.split()) for t in self.texts]

    @cached_property
    def codes(self) -> list[str]:
        return [_code(t) for t in self.texts]

    @cached_property
    def bare_places(self) -> dict[str, list[int]]:
        return _places(self.bare)

    @cached_property
    def code_places(self) -> dict[str, list[int]]:
        return _places(self.codes)

    @cached_property
    def digits(self) -> list[str]:
        return [_digits(t) for t in self.texts]

    def runs(self) -> Iterator[tuple[int, int]]:
        n = len(self.texts)
        return ((i, k) for i in range(n) for k in range(i + 1, min(i + self.most, n) + 1))

    @cached_property
    def normal(self) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """The words' normal forms, where each begins in their text without spaces, and that text's letters; None where a run's normal form may be another than its words' in a row (words of white space, marks that join the letter before, a sigma at a word's end)."""
        words = [_nfkc(t) for t in self.texts]
        text = "".join(words)
        if not text.isascii() and (not unicodedata.is_normalized("NFKC", raw := "".join(unicodedata.normalize("NFKC", t) for t in self.texts)) or "Σ" in raw):
            return None
        if not all(words) or any(len(w.split()) != 1 for w in words) or any(t != t.strip() for t in self.texts):
            return None
        return words, np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64))), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def likely(self, query: str, least: float) -> Iterator[tuple[tuple[int, int], float]]:
        """Of runs(), in the same order, those whose length and letters allow a likeness of least, with and without spaces, and what they allow at most."""
        words, size, letters = self.normal
        want, often = np.unique(np.frombuffer(query.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        n, space = len(words), query.count(" ")
        sizes = np.arange(1, min(self.most, n) + 1)
        first, last = np.repeat(np.arange(n), len(sizes)), (np.arange(n)[:, None] + sizes).ravel()
        inside = last <= n
        first, last = first[inside], last[inside]
        length, spaces = size[last] - size[first], last - first - 1
        bound = lambda have, length: 2.0 * have / (len(query) + length)
        # between the bare run and the spaced one any length is allowed, so that nothing is passed over
        some = bound(np.minimum(length + spaces, len(query)), length) >= least
        first, last, length, spaces = first[some], last[some], length[some], spaces[some]
        counts = np.zeros((len(want), len(letters) + 1), np.int32)
        np.cumsum(letters[None, :] == want[:, None], axis=1, out=counts[:, 1:])
        have = np.minimum(counts[:, size[last]] - counts[:, size[first]], often[:, None]).sum(axis=0)
        spaced, bare = bound(have + np.minimum(spaces, space), length + spaces), bound(have, length)
        most = np.maximum(spaced, bare) + 1e-9
        some = most >= least
        return zip(zip(first[some].tolist(), last[some].tolist(), strict=True), most[some].tolist(), strict=True)

    def both(self, run: tuple[int, int]) -> tuple[str, str]:
        """A run's words with spaces between, and without."""
        some = self.texts[slice(*run)]
        return " ".join(some), "".join(some)

    def exact(self, query: str) -> Found | None:
        """The same text, white space apart."""
        run = _equal(self.bare, "".join(query.split()), self.most, self.bare_places)
        return run and Found(run, 1.0, "exact")

    def exact_norm(self, query: str) -> Found | None:
        """The same in compatibility forms and lower case, with o as 0 and l as 1."""
        run = _equal(self.codes, _code(query), self.most, self.code_places)
        return run and Found(run, NORMAL, "exact_norm")

    def same_digits(self, query: str) -> Found | None:
        """The same digits; else the run whose digits are most like the query's."""
        want = _digits(query)
        if not want:
            return None
        if run := _equal(self.digits, want, self.most):
            return Found(run, DIGITS, "exact_norm")
        likest = Likest(want, ALIKE)
        for i, k in self.runs():
            likest.offer(["".join(self.digits[i:k])], (i, k))
        return likest.found(DIGITS_ALIKE, "fuzzy")

    def fitting(self, query: str, fieldtype: str) -> Found | None:
        """Of the runs that have the type's format, with spaces or without, the one most like the query by likeness times format."""
        likest = Likest(_nfkc(query), FORMAT_ALIKE)
        for run in self.runs():
            texts = self.both(run)
            fits = max(confidence(fieldtype, t) for t in texts)
            if fits >= FORMAT:
                likest.offer(map(_nfkc, texts), run, fits)
        return likest.found(1.0, "format")

    def fuzzy(self, query: str) -> Found | None:
        """The run most like the query, letter for letter. Texts are made only of runs whose length and letters allow it to be the likest so far."""
        want = _nfkc(query)
        likest = Likest(want, ALIKE)
        if self.normal is None or not want:
            for run in self.runs():
                likest.offer(map(_nfkc, self.both(run)), run)
        else:
            words = self.normal[0]
            for run, most in self.likely(want, likest.best):
                if most > likest.best:
                    some = words[slice(*run)]
                    likest.offer((" ".join(some), "".join(some)), run)
        return likest.found(1.0, "fuzzy")

    def line(self, query: str, fieldtype: str | None = None) -> Found | None:
        """One line of text by the steps in turn. Amounts and dates go by their digits first, unless the very text is there."""
        if not query.strip() or not self.texts:
            return None
        if fieldtype in DIGITS_FIRST and (found := self.same_digits(query)):
            return self.exact(query) or found
        return self.exact(query) or self.exact_norm(query) or (self.fitting(query, fieldtype) if fieldtype else None) or self.fuzzy(query)

    def text(self, query: str, fieldtype: str | None = None) -> Found | None:
        """A text; one of several lines, line by line: lines that are not found are skipped, all words of the others count, and the least confidence by .95."""
        lines = [x.strip() for x in query.split("\n") if x.strip()]
        if len(lines) <= 1:
            return self.line(query, fieldtype)
        found = [f for x in lines if (f := self.line(x, fieldtype))]
        if not found:
            return None
        return Found(tuple(k for f in found for k in f.places), LINES * min(f.confidence for f in found), "multiline_" + "+".join(sorted({f.method for f in found})))


def align(queries: DataFrame, words: DataFrame, least: float = 0.5, most: int = MOST) -> DataFrame:
    """docid, page, qid, ids (word_ids in the order found), confidence, method for queries (docid, page, qid, fieldtype, query), from least on.

    Words are taken in reading order, a run has at most most of them. A page's words and its queries are one row, and a query that repeats is looked for once.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "word_id", "text")))
    pages = r.reading_order(words, 100.0).groupBy(*PAGE).agg(ordered.alias("ws"))

    def work(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                page, known = PageWords(row.texts, most), {}
                for qid, *key in zip(row.qids, row.queries, row.fieldtypes, strict=True):
                    if (key := tuple(key)) not in known:
                        known[key] = page.text(*key)
                    if (f := known[key]) and f.confidence >= least:
                        rows.append((row.docid, row.page, qid, [int(row.word_ids[k]) for k in f.places], f.confidence, f.method))
            yield pd.DataFrame(rows, columns=["docid", "page", "qid", "ids", "confidence", "method"])

    wanted = queries.where("query <> ''").groupBy(*PAGE).agg(F.collect_list(F.struct("qid", "fieldtype", "query")).alias("qs"))
    # plain values: structs would be a dict for each word
    both = wanted.join(pages, PAGE).select(*PAGE, F.col("qs.qid").alias("qids"), F.col("qs.query").alias("queries"), F.col("qs.fieldtype").alias("fieldtypes"), F.col("ws.text").alias("texts"), F.col("ws.word_id").alias("word_ids"))
    return both.mapInPandas(work, f"docid {queries.schema['docid'].dataType.simpleString()}, page int, qid long, ids array<int>, confidence double, method string")


def text_fields(predictions: DataFrame, words: DataFrame, least: float = 0.75) -> DataFrame:
    """predictions (docid, page, qid, query, and others) with left, top, right, bottom and matched: the box and text of the run that find_spans gives; those not found are dropped."""
    found = sp.find_spans(predictions, words, least)
    spans = found.select(*PAGE, "qid", F.sequence("first", "last").alias("word_ids"))
    boxes = joins.union_of_words(spans, words, ["qid"]).withColumnRenamed("text", "matched")
    return predictions.join(boxes, [*PAGE, "qid"])


def text_fields_of_pages(lines: DataFrame, words_of: Callable[[pa.Array], pg.Words], asked: Callable[[pg.Words], tuple[np.ndarray, np.ndarray, pa.Array]], least: float = 0.75) -> DataFrame:
    """docid, page, qid and left, top, right, bottom, matched of text_fields() for pages (docid, page, lines) whose words and predictions (their page's place, ascending, qid and query) are made where they are needed."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in pg.pieces(b):
                w = words_of(some.column("lines"))
                on, qid, queries = asked(w)
                spelling, texts = w.spelt
                found = sp.find_in_pages(aligned_all(texts), spelling, w.page, aligned_all(queries), on, least)
                hits = np.array([k for k, f in enumerate(found) if f], np.int64)
                first, n = np.array([found[k][0] for k in hits], np.int64), np.array([found[k][1] - found[k][0] + 1 for k in hits], np.int64)
                runs = pg.Spans(on[hits], np.repeat(np.arange(len(hits)), n), pg.places(first, n))
                keys = [some.column(c).take(pa.array(runs.page)) for c in PAGE]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(qid[hits]), *map(pa.array, runs.box(w)), runs.texts(w)], [*PAGE, "qid", "left", "top", "right", "bottom", "matched"])

    known = lines.where(F.col("docid").isNotNull())
    return known.mapInArrow(work, f"docid {known.schema['docid'].dataType.simpleString()}, page int, qid long, left double, top double, right double, bottom double, matched string")


def resolve_boxes(values: DataFrame, regions: DataFrame, words: DataFrame, mode: str = "words", least: float = 0.75) -> DataFrame:
    """docid, page, vid, l, t, r, b, how: a box for each value (docid, page, vid, value), or none.

    The value's region is that of fuzzy_region (regions: docid, page, ord, text, l, t, r, b). Mode "region": the region's box, else the run of
    the page's words most like the value. Mode "words": the run among the words whose centre the region holds, else the region's
    box, else the page's run.
    """
    if mode not in ("region", "words"):
        raise ValueError("mode must be region or words")
    side = lambda how: [F.col(a).alias(b) for a, b in zip(("left", "top", "right", "bottom"), "ltrb", strict=True)] + [F.lit(how).alias("how")]
    keys, box = [*PAGE, "vid"], ["l", "t", "r", "b", "how"]
    matched = fuzzy_region(values, regions).join(regions.drop("text"), [*PAGE, "ord"]).select(*keys, "l", "t", "r", "b")
    queries = values.select(*PAGE, F.col("vid").alias("qid"), F.col("value").alias("query"))
    everywhere = text_fields(queries, words, least).select(*PAGE, F.col("qid").alias("vid"), *side("page"))
    by_region = matched.withColumn("how", F.lit("region"))
    steps = [by_region, everywhere]
    if mode == "words":
        inside = joins.words_in_boxes(words, matched)
        found = sp.find_inside(values.join(matched.select(*keys), keys), inside, keys, least)
        scoped = joins.union_of_words(found, words, ["vid"]).select(*keys, *side("words"))
        steps = [scoped, by_region, everywhere]
    ranked = reduce(DataFrame.unionByName, [s.select(*keys, *box, F.lit(k).alias("step")) for k, s in enumerate(steps)])
    best = ranked.groupBy(*keys).agg(F.min(F.struct("step", *box)).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in box))


def verify(candidates: DataFrame, texts: DataFrame, keywords: DataFrame, choices: DataFrame | None = None, unsure: float = 0.4) -> DataFrame:
    """docid, page, span_id, ord, score of the best of a span's candidates (docid, page, span_id, ord, text): .6 for the share of the field's keywords in the text and .4 for likeness to the extracted text (texts: docid, page, span_id, extracted; keywords: docid, page, span_id, words).

    The proposed one, ord 0, stays if no score reaches .1; the first of equals counts. Where the best is under unsure, a provider's recorded choice
    (docid, page, span_id, choice) among the span's candidates decides, if there is one.
    """
    from pagefold.functions.text import sequence_ratio

    keys = [*PAGE, "span_id"]
    both = candidates.join(texts, keys).join(keywords, keys)
    hits = F.size(F.filter("words", lambda w: F.contains(F.lower("text"), w)))
    score = 0.6 * F.coalesce(F.try_divide(hits, F.size("words")), F.lit(0.0)) + 0.4 * sequence_ratio(F.lower("extracted"), F.lower("text"))
    best = both.withColumn("score", score).groupBy(*keys).agg(F.max(F.struct("score", (-F.col("ord")).alias("minus"))).alias("x"), F.collect_set("ord").alias("ords"))
    own = F.when(F.col("x.score") < 0.1, F.lit(0)).otherwise(-F.col("x.minus"))
    if choices is None:
        return best.select(*keys, own.alias("ord"), "x.score")
    said = (F.col("x.score") < unsure) & F.array_contains("ords", F.coalesce("choice", F.lit(-1)))
    return best.join(choices.select(*keys, "choice"), keys, "left").select(*keys, F.when(said, F.col("choice")).otherwise(own).alias("ord"), "x.score")


def run_program(words: DataFrame, program: Callable[[list[dict]], list[dict]], types: Sequence[str], seconds: float = 5.0) -> DataFrame:
    """docid, page, ord, fieldtype, word_ids of a user's function on each page's words (dicts with word_id, text, left, top, right, bottom), which returns dicts with fieldtype and word_ids.

    A page on which it fails or takes longer gives no rows. Items of unknown type, or whose ids are not all whole numbers, are dropped. The function is the
    caller's own code, shipped as such; programs that are text are rows of apply_rules instead, never executed.
    """
    cols = ("word_id", "text", "left", "top", "right", "bottom")
    known = frozenset(types)
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("ws"))

    def good(x) -> bool:
        return isinstance(x, dict) and x.get("fieldtype") in known and isinstance(x.get("word_ids"), list) and all(type(i) is int for i in x["word_ids"])

    def work(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for page in b.itertuples(index=False):
                pool = ThreadPoolExecutor(1)
                try:
                    found = pool.submit(program, [dict(w) for w in page.ws]).result(timeout=seconds)
                except Exception:  # whatever the user's code does, the page has no rows
                    found = None
                pool.shutdown(wait=False, cancel_futures=True)
                items = [x for x in found if good(x)] if isinstance(found, list) else []
                rows += [(page.docid, page.page, k, x["fieldtype"], x["word_ids"]) for k, x in enumerate(items)]
            yield pd.DataFrame(rows, columns=["docid", "page", "ord", "fieldtype", "word_ids"])

    return pages.mapInPandas(work, f"docid {words.schema['docid'].dataType.simpleString()}, page int, ord int, fieldtype string, word_ids array<int>")


def verified_by(fields: DataFrame, *verifiers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fields after each verifier in turn, a function from fields to fields."""
    return reduce(DataFrame.transform, verifiers, fields)


def apply_rules(words: DataFrame, rules: DataFrame, docs: DataFrame, score: float = 0.9) -> DataFrame:
    """docid, page, word_id, fieldtype, score: rules (cluster, fieldtype, label, pattern, reach) are rows, not programs. A rule finds words that have its pattern and stand at most reach words after its label, in its cluster's documents."""
    mine = docs.select("docid", "cluster").join(rules, "cluster")
    label = words.select(*PAGE, F.col("word_id").alias("label_at"), F.lower("text").alias("label"))
    anchors = label.join(mine, ["docid", "label"])
    near = (F.col("word_id") > F.col("label_at")) & (F.col("word_id") <= F.col("label_at") + F.col("reach"))
    return words.join(anchors, PAGE).where(near & F.expr("text rlike pattern")).select(*PAGE, "word_id", "fieldtype", F.lit(score).alias("score")).distinct()


def prefer(found: DataFrame, base: DataFrame) -> DataFrame:
    """Page-level fields of found for documents that have any, else base's; row-grouped fields are always base's."""
    has = found.where("li is null").select("docid").distinct()
    return found.where("li is null").unionByName(base.where("li is null").join(has, "docid", "left_anti")).unionByName(base.where("li is not null"))


def hints(finds: DataFrame) -> DataFrame:
    """docid, page, hint: the sure finds (score 1), as lines in order of type and place."""
    sure = finds.where("score = 1.0")
    line = F.concat_ws(": ", "fieldtype", "text")
    lines = F.array_sort(F.collect_list(F.struct("fieldtype", "start", line.alias("line"))))
    return sure.groupBy(*PAGE).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("hint"))


def fuzzy_region(values: DataFrame, regions: DataFrame, least: float = 60.0) -> DataFrame:
    """docid, page, vid, ord, ratio: the region (docid, page, ord, text) whose text has the part most like each value (docid, page, vid, value), from least on; the first of equals."""
    from pagefold.functions.text import partial_ratio

    both = values.join(regions, PAGE).withColumn("ratio", partial_ratio("value", "text")).where(F.col("ratio") >= least)
    return both.groupBy(*PAGE, "vid").agg(F.max(F.struct("ratio", (-F.col("ord")).alias("minus"))).alias("x")).select(*PAGE, "vid", (-F.col("x.minus")).alias("ord"), "x.ratio")
