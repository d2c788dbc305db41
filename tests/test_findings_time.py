"""Operators that took too long, against the plainer ways they had."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.operators import align, codes, joins, rows

DDL = "docid long, page int, word_id int, text string, left double, top double, right double, bottom double"


def random_words(spark, seed, some, docs=60, pages=3, most=16):
    """Pages of words in no order of place, some of them on the same place."""
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        for p in r.sample(range(pages), r.randint(1, pages)):
            for i in range(r.randint(1, most)):
                left, top = r.randint(0, 9) / 10, r.randint(0, 6) / 50
                rows.append((d, p, i, r.choice(some), left, top, left + 0.05, top + 0.01))
    r.shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(5)


CODE_WORDS = """DEUTDEDB deutdeff DEUT DEFF500 12345678 1234 5678-90 - 12-34 DE123456789 DE 12345 HRB-77/12 INV.2024 VAT tax id Tax ID: swift bank code account no. númeró číslo účtu ref your Ref
Invoice invoice inv # x reg 99 Ümlaut-22 straße STRASSE ﬁnanz DEUTDEß1 ١٢٣٤٥٦٧٨ ١٢٣ ſtudent ıstanbul é²½Ⓐ1 ½½½½½½ K1234567 a\tb\t12345 ab12345 \u2003 12345\u00a0678 GB29 NWBK 6016 1331 9268 19
DE89370400440532013000 DE00370400440532013000 de89370400440532013000 GB29NWBK60161331926819\r ß3612 ΑΣ café́1 Abc-12 ABC-12""".replace("\n", " ").split(" ")


def test_every_find_is_that_of_each_type(spark, monkeypatch):
    """One pass with the same finds as a union of finds() and ibans(), whatever characters words have, and batches smaller than documents."""
    words = random_words(spark, 61, CODE_WORDS)
    each = [(codes.ibans(words) if t == "iban" else codes.finds(words, t)).withColumn("fieldtype", F.lit(t)) for t in ("iban", *codes.CODES)]
    key = F.upper(F.replace("text", F.lit(" "), F.lit("")))
    best = reduce(DataFrame.unionByName, each).withColumn("key", key).groupBy("docid", "fieldtype", "key").agg(F.min_by(F.struct("page", "pos", "ids", "text", "score"), F.struct(-F.col("score"), "page", "pos")).alias("x"))
    want = sorted(map(tuple, best.select("docid", "x.page", "fieldtype", "x.pos", "x.ids", "x.text", "x.score").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = codes.every_find(words)
        assert sorted(map(tuple, got.collect())) == want and {x[2] for x in want} == {"iban", *codes.CODES}
        assert sorted(x.docid for x in codes.every_find(words, ["bic"], ["docid"]).collect()) == sorted(x[0] for x in want if x[2] == "bic")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(codes, "AT_ONCE", 50)
    assert sum(b.num_rows for b in codes._whole_documents(words.orderBy("docid").select("docid", "page").toArrow().to_batches(9), lambda t: t)) == words.count()


def test_a_pass_over_whole_documents(spark):
    """The words of a document are dealt once, and all types are found in one pass over them."""
    plan = codes.every_find(random_words(spark, 62, ["a", "b"], docs=3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(") == 1


@pytest.mark.parametrize("lines", [True, False])
def test_window_totals_are_those_of_the_windows(spark, lines):
    words = random_words(spark, 63, ["a", "bcd", "é😀", "", "x" * 30])
    want = rows.candidate_windows(words, 5, lines, apart=0.05).groupBy("docid", "page").agg(F.count("*").alias("n"), F.sum(F.length("spaced")).alias("characters"))
    assert sorted(rows.window_totals(words, 5, lines, apart=0.05).collect()) == sorted(want.collect())
    assert rows.window_totals(words.limit(0)).count() == 0


def test_address_windows_make_no_runs(spark, tmp_path):
    """As in SQL, on arrays of the page's words that are never exploded into runs."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrstuvwxyz") + "\nx yy é\n\nzz\nw"), (2, None), (3, " "), (4, "one")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["address_windows"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(entry.oracle_sql()["address_windows"]).fetchall())
    assert df._jdf.queryExecution().executedPlan().toString().count("Generate inline") == 0


FUZZY_WORDS = "total Total amount amounts due dve 12.50 12,50 the of invoice invoıce Straße strasse ﬁnal é e\u0301 \u0301a ΑΣ ας a\tb \u00a0 x\u00a0 가 \u1100 \u1161 𝐀b ab abab".split(" ")


def plain_fuzzy(page, query):
    """fuzzy() by offering every run."""
    likest = align.Likest(align._nfkc(query), align.ALIKE)
    for run in page.runs():
        likest.offer(map(align._nfkc, page.both(run)), run)
    return likest.found(1.0, "fuzzy")


def test_fuzzy_finds_what_looking_at_every_run_finds():
    r = random.Random(64)
    found = 0
    for k in range(3000):
        words = r.choices(FUZZY_WORDS[:11] if k % 2 else FUZZY_WORDS, k=r.randint(1, 30))
        at = r.randrange(len(words))
        query = list(r.choice([" ", ""]).join(words[at : at + r.randint(1, 6)]))
        for _ in range(r.randint(0, 2)):
            query[r.randrange(len(query))] = r.choice("xyz 1Σ")
        page = align.PageWords(words, r.choice([3, 20]))
        want = plain_fuzzy(page, "".join(query))
        assert page.fuzzy("".join(query)) == want, (words, query)
        found += want is not None
    assert found > 1000


def test_fuzzy_compares_few_runs(monkeypatch):
    """Runs too long, too short or of other letters are not even made into texts."""
    made = []
    monkeypatch.setattr(align.Likest, "offer", lambda self, texts, run, weight=1.0: made.append(run))
    page = align.PageWords("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split() * 20)
    assert page.fuzzy("ipsxm dolor sit") is None and 0 < len(made) <= 60


def test_nearest_label_is_that_of_the_surroundings(spark, monkeypatch):
    """With the spans' own boxes or those of their words; unknown and repeated ids, none at all, equal distances."""
    words = random_words(spark, 65, ["the", " Of", "x", "y", "z"])
    r = random.Random(66)
    some = [(d, p, k, [None if r.random() < 0.05 else r.randint(0, 18) for _ in range(r.randint(0, 4))], *(round(r.random(), 1) for _ in range(4))) for d in range(60) for p in range(3) for k in range(5)]
    spans = spark.createDataFrame(some, "docid long, page int, span_id int, word_ids array<int>, l double, t double, r double, b double").repartition(3)
    boxes = joins.union_of_words(spans, words, ["span_id"]).select("docid", "page", "span_id", *(F.col(a).alias(b) for a, b in zip(("left", "top", "right", "bottom"), "ltrb", strict=True)))
    bare = spans.drop(*"ltrb")
    monkeypatch.setattr(joins, "PAIRS", 20)
    monkeypatch.setattr(joins, "PAGES", 7)
    for given, same in ((spans, spans), (bare, bare.join(boxes, ["docid", "page", "span_id"]))):
        full = joins.surroundings(same.withColumn("word_ids", F.filter("word_ids", lambda x: x.isNotNull())), words, ["the", "of"]).select("docid", "page", "span_id", "label", "dist")
        got, want = (sorted(map(tuple, x.collect())) for x in (joins.nearest_label(given, words, ["the", "of"]), full))
        assert got == want and len({x[3] for x in got}) == 3
    assert joins.nearest_label(bare, words, []).where("label <> '' or dist <> 2.0").count() == 0
    assert joins.nearest_label(bare.limit(0), words, ["the"]).count() == 0


def test_nearest_label_joins_pages_alone(spark, tmp_path):
    """Words and spans meet as arrays, once; words are never joined by their numbers."""
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "a the b of c")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = entry.queries()["nearest_label"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join [") == 1
