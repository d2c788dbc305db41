"""Operators that took too long at 1 GB, against the plainer ways they had."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagefold.functions import pages as pg
from pagefold.functions import text as t
from pagefold.operators import align, joins, learning, refine, spans
from pagefold.operators.rows import reading_order
from pagefold.sources import views

PAGE = ["docid", "page"]
DDL = "docid long, page int, word_id int, text string, left double, top double, right double, bottom double"
SOME = ["Total", " date ", "x", "y 1", "12/03/2024", "€12.50", "", "é٣٤", "DE89370400440532013000", "no"]
TEXTS = {1: " ".join(map(str, range(40))) + "\nx yy é total\n\nno  no\nw", 2: None, 3: " ", 4: "one", 5: "a  total 12.50 EUR\n" * 9 + "€1 2 3 $ due", 6: "b\n c\nd e\n"}


def random_words(spark, seed, unit, docs=30):
    """Pages of words in no order of place, some of them on the same place; unit: what coordinates are parts of."""
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        for p in range(r.randint(1, 3)):
            for i in range(r.randint(1, 25)):
                left, top = r.randint(0, 12) / unit, r.randint(0, 5) / unit
                rows.append((d, p, i, r.choice(SOME), left, top, left + r.randint(0, 3) / unit, top + 1 / (2 * unit)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(5)


def plain_attributes(some, words):
    """attributes() by joins of words."""
    held = refine.span_words(some, words)
    side = lambda f, c: f(F.transform("ws", lambda w: w[c]))
    box = [side(F.array_min, "left").alias("l"), side(F.array_min, "top").alias("t"), side(F.array_max, "right").alias("r"), side(F.array_max, "bottom").alias("b")]
    spread = held.select(*PAGE, "span_id", "word_ids", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), F.size("ws").alias("word_count"), *box)
    around = joins.surroundings(spread.select(*PAGE, "span_id", "word_ids", *"ltrb"), words, learning.LABELS)
    digits, text = F.length(F.regexp_replace("text", r"(?U)\D", "")), F.col("text")
    looks = {
        "char_count": F.length(text), "has_digits": digits > 0, "digit_ratio": digits / F.greatest(F.length(text), F.lit(1)), "has_letters": text.rlike(r"\p{L}"), "has_currency": text.rlike(learning.CURRENCY),
        "like_iban": F.replace(F.upper(text), F.lit(" "), F.lit("")).rlike(learning.IBAN), "like_date": text.rlike(learning.DATE), "like_amount": text.rlike(learning.AMOUNT),
        "left": F.col("l"), "top": F.col("t"), "width": F.col("r") - F.col("l"), "height": F.col("b") - F.col("t"),
    }
    return spread.withColumns(looks).join(around, [*PAGE, "span_id"]).select(*PAGE, "span_id", *learning.ATTRIBUTES)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("unit", [10, 64])
def test_attributes_are_those_of_joins(spark, monkeypatch, unit):
    """Of decimal coordinates, which are compared, and of binary ones, which are looked up; unknown and repeated ids, none at all, words on one place."""
    monkeypatch.setattr(pg, "PAIRS", 40)
    monkeypatch.setattr(pg, "WORDS", 60)
    words, r = random_words(spark, 71, unit), random.Random(72)
    some = [(d, p, k, [r.randint(0, 27) for _ in range(r.randint(0, 4))]) for d in range(30) for p in range(3) for k in range(6)]
    df = spark.createDataFrame(some, "docid long, page int, span_id int, word_ids array<int>").repartition(3)
    got = learning.attributes(df, words)
    assert rows(got) == rows(plain_attributes(df, words)) and got.count() > 100
    one, two = got.select(learning.vector()), learning.looks(learning._around_spans(df, words, learning.NUMBERS)).select(learning.vector(made=True))
    assert np.allclose(sorted(x[0] for x in one.collect()), sorted(x[0] for x in two.collect()), atol=1e-12)
    assert learning.attributes(df.limit(0), words).count() == 0


def test_surroundings_are_looked_up(monkeypatch):
    """On binary coordinates without comparing spans with words, the same as by comparing them."""
    r, g = random.Random(73), np.random.default_rng(74)
    for k in range(60):
        page = np.repeat(np.arange(4), g.integers(0, 30, 4))
        n = len(page)
        left, top = g.integers(0, 20, n) / 64, g.integers(0, 8, n) / 128
        w = pg.Words(page, np.arange(n) - np.searchsorted(page, page), pa.array(["x"] * n), left, top, left + g.integers(0, 5, n) / 64, top + g.integers(0, 3, n) / 128)
        some = [sorted((r.randrange(4), r.randint(0, 40), r.randint(1, 3)) for _ in range(20))][0]
        s = pg.named(w, np.array([x[0] for x in some]), pa.array([list(range(x[1], x[1] + x[2])) for x in some], pa.list_(pa.int32())))
        s = s.only(s.kept())
        box = s.box(w)
        assert all((a == b).all() for a, b in zip(pg.around(w, s, box, 0.045 * (k % 3)), pg._compared(w, s, box, 0.045 * (k % 3)), strict=True))
    monkeypatch.setattr(pg, "_compared", None)
    assert len(pg.around(w, s, box, 0.045)) == 4


@pytest.fixture
def folder(spark, tmp_path):
    some = [*TEXTS.items(), (None, "lost words of no document")]
    spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["feature_vector", "span_attributes"])
def test_spans_and_words_are_never_rows(spark, folder, name):
    """As in SQL, in one pass over pages' lines; before, words were joined with spans, grouped and joined again."""
    df = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    assert rows(df.select(*want.columns)) == sorted(want.fetchall(), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_words_of_lines_are_the_words(spark, folder):
    lines = views.page_lines(spark, folder).toArrow().combine_chunks().to_batches()[0]
    w = views.words_of(lines.column("lines"))
    docs, pages = (np.array(lines.column(c).to_pylist(), object)[w.page].tolist() for c in PAGE)
    assert sorted(zip(docs, pages, w.ids.tolist(), w.text.to_pylist(), *(x.tolist() for x in (w.left, w.top, w.right, w.bottom)), strict=True), key=repr) == rows(views.words(spark, folder))


def plain_training(fields, words, per_page):
    """Keys, ids of words and label of training_set()'s spans by joins."""
    own = fields.where("fieldtype = 'code'").select(*PAGE, *"ltrb").distinct()
    held = joins.words_in_boxes(words, own, 0.005)
    positive = held.groupBy(*PAGE, *"ltrb").agg(F.sort_array(F.collect_list("word_id")).alias("word_ids")).select(*PAGE, "word_ids", F.lit(1).alias("y"))
    runs = spans.negative_spans(held.select(*PAGE, "word_id").distinct(), words, per_page)
    both = positive.unionByName(runs.select(*PAGE, F.sequence("start", F.col("start") + F.col("n") - 1).alias("word_ids"), F.lit(0).alias("y")))
    return both.withColumn("span_id", F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("y"), "word_ids")))


@pytest.mark.parametrize(("unit", "per_page", "wide"), [(10, 2, 1), (64, 5, 1), (64, 40, 9)])
def test_training_set_is_that_of_joins(spark, monkeypatch, unit, per_page, wide):
    """The same spans with the same numbers and features; boxes that repeat, hold nothing, or nearly all."""
    monkeypatch.setattr(pg, "WORDS", 60)
    monkeypatch.setattr(pg, "PAIRS", 40)
    words, r = random_words(spark, 75, unit).where("word_id <> 4"), random.Random(76)
    boxes = [(d, p, r.choice(["code", "code", "other"]), x := r.randint(0, 12) / unit, y := r.randint(0, 5) / unit, x + r.randint(0, wide) / unit, y + wide / unit) for d in range(31) for p in range(3) for _ in range(r.randint(0, 3))]
    fields = spark.createDataFrame([*boxes, *boxes[:9]], "docid long, page int, fieldtype string, l double, t double, r double, b double")
    want = plain_training(fields, words, per_page)
    got = learning.training_set(fields, words, "code", per_page).select(*PAGE, "span_id", "features", "label").collect()
    full = want.select(*PAGE, "span_id", "y").join(plain_attributes(want.drop("y"), words), [*PAGE, "span_id"]).select(*PAGE, "span_id", "y", learning.vector().alias("v"))
    made = {tuple(x)[:3]: (x.label, x.features.toArray().tolist()) for x in got}
    expected = {tuple(x)[:3]: (x.y, x.v) for x in full.collect()}
    assert len(made) == len(got) and made.keys() == expected.keys() and {x[0] for x in made.values()} == {0, 1}
    assert all(made[k][0] == expected[k][0] and made[k][1] == pytest.approx(expected[k][1], abs=1e-12) for k in made)


def test_training_set_query_makes_no_runs(spark, folder):
    """In one pass over pages' lines; before, every run of up to four words was a row, and put in order by its hash."""
    df = entry.queries()["training_set"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    w = views.words(spark, folder).where("docid is not null")
    fields = w.where("word_id % 10 = 0").select(*PAGE, F.lit("code").alias("fieldtype"), *(F.col(a).alias(b) for a, b in zip(("left", "top", "right", "bottom"), "ltrb", strict=True)))
    assert rows(df) == rows(plain_training(fields, w, 5).groupBy("docid", F.col("y").alias("label")).agg(F.count("*").alias("n")))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan


def test_likeness_is_difflibs():
    r = random.Random(77)
    for k in range(3000):
        a, b = ("".join(r.choices("ab c" if k % 2 else "abcdefgh ij", k=r.randint(0, 24))) for _ in "ab")
        assert spans.likeness(a, b) == SequenceMatcher(None, a, b).ratio()
    a, b = ("".join(r.choices("abcdef ", k=230)) for _ in "ab")
    assert spans.likeness(a, b) == SequenceMatcher(None, a, b).ratio()


def test_normal_texts_are_those_of_each():
    some = ["", None, "a", "A.b,c", "_x_", " a\tb ", "\x1ca\x1fb", "---", "É à", "ﬁ½", "a\u00a0b", "Straße!", "I'll", "x" * 40, "٣-٤", "12.50€"]
    assert t.aligned_all(pa.array(some)) == [t.aligned(x) or "" for x in some]


def test_many_pages_are_searched_as_one(monkeypatch):
    """Each query as find_span has it on its page: words that are empty or have spaces, ties, and queries too long for bits of a number, or for difflib."""
    r, found = random.Random(78), 0
    monkeypatch.setattr(pg, "PAIRS", 60)
    some = ["total", "totel", "a", "b", "", "a b", "due", "dve", "of", "é", "aa", "invoice", "x" * 30, "x" * 29 + "y", "abcdefghijklmnopqrst" * 6]
    for k in range(120):
        pages = [r.choices(some, k=r.choice([0, 1, 3, 15])) for _ in range(4)]
        texts = sorted(set(some))
        flat = [w for p in pages for w in p]
        page = np.repeat(np.arange(4), [len(p) for p in pages])
        on = np.array(sorted(r.randrange(4) for _ in range(12)))
        queries = [" ".join(" ".join(r.choices(some, k=r.randint(1, 4))).split()) for _ in on]
        least = r.choice([0.75, 0.5, 0.9])
        got = spans.find_in_pages(texts, np.array([texts.index(w) for w in flat], np.int64), page, queries, on, least)
        first = np.searchsorted(page, np.arange(4))
        for q, p, f in zip(queries, on, got, strict=True):
            want = spans.find_span(q, pages[p], least) if q else None
            assert f == (want and (want[0] + first[p], want[1] + first[p], want[2])), (q, pages[p], f, want)
            found += want is not None and want[2] < 1
    assert found > 100


def test_few_runs_are_compared(monkeypatch):
    """Of a text that isn't there, only with runs whose longest common sequence allows it; before, with all whose letters did."""
    made = []
    likeness = spans.likeness
    monkeypatch.setattr(spans, "likeness", lambda a, b: made.append(b) or likeness(a, b))
    words = "lorem ipsum dolor sit amet silo mid term muse pile rot dolor lorem isp".split() * 9
    texts = sorted(set(words))
    got = spans.find_in_pages(texts, np.array([texts.index(w) for w in words]), np.zeros(len(words), int), ["ipsun dolor sit", "tem mid silor"], np.array([0, 0]))
    assert got[0][:2] == (1, 3) and len(made) < 40


def test_text_fields_query_is_that_of_joins(spark, folder):
    """The rows of text_fields() on tables of predictions and words, in one pass over pages' lines."""
    df = entry.queries()["text_fields"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan
    w = views.words(spark, folder).where("docid is not null")
    placed = reading_order(w, 100.0).withColumn("qid", ((F.col("place") - 1) / 3).cast("long"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    asked = placed.where("qid % 7 = 0").groupBy(*PAGE, "qid").agg(F.array_join(texts, " ").alias("query"))
    assert rows(df) == rows(align.text_fields(asked, w).select(*PAGE, "qid", "matched")) and df.count() > 5
