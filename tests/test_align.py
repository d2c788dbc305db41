import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pagefold.functions import catalog, validators
from pagefold.operators import align, learning


def page(spark, *texts):
    return spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(texts)], "docid long, page int, word_id int, text string")


def brute(query, words, fieldtype=None, most=20):
    """The steps one after another over every run, without the shortcuts."""
    runs = [(i, k) for i in range(len(words)) for k in range(i + 1, min(i + most, len(words)) + 1)]
    spaced = lambda x: " ".join(words[slice(*x)])
    bare = lambda x: "".join(words[slice(*x)])
    like = lambda x, q: max(SequenceMatcher(None, align._nfkc(f(x)), align._nfkc(q)).ratio() for f in (spaced, bare))

    def best(score, least):
        scored = [(score(x), x) for x in runs]
        top = max((s for s, _ in scored), default=0)
        return next(((x, s) for s, x in scored if s == top), None) if top >= least else None

    def line(q):
        exact = next((x for x in runs if spaced(x).split() == q.split() or bare(x) == "".join(q.split())), None)
        if fieldtype in align.DIGITS_FIRST and (want := align._digits(q)):
            same = next((x for x in runs if align._digits(bare(x)) == want), None)
            near = best(lambda x: SequenceMatcher(None, align._digits(bare(x)), want).ratio(), 0.85)
            if exact and (same or near):
                return exact, 1.0, "exact"
            if same:
                return same, 0.9, "exact_norm"
            if near:
                return near[0], near[1] * 0.88, "fuzzy"
        if exact:
            return exact, 1.0, "exact"
        if same := next((x for x in runs if align._code(bare(x)) == align._code(q)), None):
            return same, 0.95, "exact_norm"
        if fieldtype:
            fits = lambda x: max(validators.confidence(fieldtype, f(x)) for f in (spaced, bare))
            if found := best(lambda x: like(x, q) * fits(x) if fits(x) >= 0.8 else 0.0, 0.7):
                return *found, "format"
        found = best(lambda x: like(x, q), 0.85)
        return (*found, "fuzzy") if found else None

    lines = [x.strip() for x in query.split("\n") if x.strip()]
    got = [f for x in lines if (f := line(x))]
    if len(lines) <= 1 or not got:
        return (tuple(range(*got[0][0])), got[0][1], got[0][2]) if got else None
    return tuple(k for f in got for k in range(*f[0])), 0.95 * min(f[1] for f in got), "multiline_" + "+".join(sorted({f[2] for f in got}))


def test_cascade_against_brute_force():
    r = random.Random(31)
    vocabulary = "Invoice No Total EUR 1.234,50 1234.56 12/03/2024 2024-01-15 DE89370400440532013000 GB29 NWBK 6016 1331 9268 19 Acme Ltd Berlin Street 12 lO0l A-77 due Ümlaut".split()
    types = [None, "vendor_name", "amount_due", "date_issue", "iban", "document_id", "vendor_address", "line_item_quantity"]
    methods = set()
    for _ in range(400):
        words = r.choices(vocabulary, k=r.randint(0, 9))
        i = r.randrange(len(words) + 1)
        query = " ".join(words[i : i + r.randint(1, 4)]) or r.choice(vocabulary)
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(query))
            query = query[:k] + r.choice("xO01 .") + query[k + r.randint(0, 1) :]
        query = r.choice([query, query.upper(), query.replace(" ", ""), query + "\n" + r.choice(vocabulary)])
        kind = r.choice(types)
        want, found = brute(query, words, kind), align.PageWords(words).text(query, kind)
        if want is None:
            assert found is None, (query, words, kind, found)
        else:
            methods.add(want[2])
            assert found is not None and found.places == want[0] and abs(found.confidence - want[1]) < 1e-12 and found.method == want[2], (query, words, kind, want, found)
    assert {"exact", "exact_norm", "format", "fuzzy"} <= methods and any(m.startswith("multiline") for m in methods)


def test_known_cases():
    text = lambda q, ws, kind=None: align.PageWords(ws.split()).text(q, kind)
    assert text("Acme Holdings Ltd", "Acmee Holdng Limited", "vendor_name").method == "format"
    assert text("Acme Ltd\nBerlin", "Acme Ltd Invoice No 7 Berlin", "vendor_address").places == (0, 1, 5)
    assert text("DE89370400440532", "IB AN DE89 3704 0O44 05 32").confidence == 0.95
    assert text("zzz", "a b") is None and text("  ", "a") is None


def test_confidence_equals_the_columns(spark):
    texts = ["GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "DEUTDEDB", "deutdedbxxx ", "DE 123", "DE123456789", "12-345.67", "", " ", "1.234,50", "€ 12", "12 EUR", "12%", "101 %", "0.5", "2024-01-15", "2024-1-5", "2024-13-45", "1/2/24", "5 Jan 2024", "Jan 5, 2024", "USD", "usd", "XXX", "$", "a@b.co", "a@b", "-5,5", "7", "7a", "HRB 123/4", "#", "ABC1"]
    types = [t for f in catalog.FAMILIES.values() for t in f[:1]] + ["vendor_name"]
    df = spark.createDataFrame([(t, x) for t in types for x in texts], "ft string, text string")
    for row in df.withColumn("c", validators.format_confidence(F.col("ft"), F.col("text"))).collect():
        assert row.c == validators.confidence(row.ft, row.text), row


def test_align(spark):
    queries = spark.createDataFrame([(1, 0, 5, "vendor_name", "b c"), (1, 0, 6, "iban", "nowhere at all"), (1, 0, 7, None, None), (1, 0, 8, None, "c\na")], "docid long, page int, qid long, fieldtype string, query string")
    rows = [(1, 0, i, x, 0.1 * c, 0.1 * r, 0.1 * c + 0.05, 0.1 * r + 0.02) for i, (x, c, r) in enumerate([("c", 1, 1), ("a", 0, 0), ("b", 0, 1)])]
    words = spark.createDataFrame(rows, "docid long, page int, word_id int, text string, left double, top double, right double, bottom double")
    assert sorted((r.qid, r.ids) for r in align.align(queries, words).collect()) == [(5, [2, 0]), (8, [0, 1])]


def test_boxes_of_values(spark):
    texts = "Bill to ACME Corp Ltd and others ACME Corp".split()
    words = spark.createDataFrame([(1, 0, i, x, 0.1 * i, 0.1, 0.1 * i + 0.05, 0.12) for i, x in enumerate(texts)], "docid long, page int, word_id int, text string, left double, top double, right double, bottom double")
    regions = spark.createDataFrame([(1, 0, 0, "acme corp", 0.65, 0.0, 1.0, 0.2), (1, 0, 1, "empty space", 0.0, 0.5, 1.0, 0.9)], "docid long, page int, ord int, text string, l double, t double, r double, b double")
    values = spark.createDataFrame([(1, 0, 1, "ACME Corp"), (1, 0, 2, "empty space"), (1, 0, 3, "bill to")], "docid long, page int, vid int, value string")
    got = {r.vid: (round(r.l, 2), round(r.r, 2), r.how) for r in align.resolve_boxes(values.withColumn("value", F.lower("value")), regions, words).collect()}
    assert got == {1: (0.7, 0.85, "words"), 2: (0.0, 1.0, "region"), 3: (0.0, 0.15, "page")}
    got = {r.vid: r.how for r in align.resolve_boxes(values.withColumn("value", F.lower("value")), regions, words, "region").collect()}
    assert got == {1: "region", 2: "region", 3: "page"}


def test_rules(spark):
    rules = spark.createDataFrame([(3, "document_id", "no:", r"^\d+$", 2)], "cluster int, fieldtype string, label string, pattern string, reach int")
    docs = spark.createDataFrame([(1, 3), (2, 4)], "docid long, cluster int")
    got = align.apply_rules(page(spark, "No:", "#", "123", "456"), rules, docs).collect()
    assert [(r.word_id, r.fieldtype) for r in got] == [(2, "document_id")]


def test_verify(spark):
    some = spark.createDataFrame([(1, 0, 1, 0, "total"), (1, 0, 1, 1, "total 12.00"), (1, 0, 2, 0, "q"), (1, 0, 2, 1, "r")], "docid long, page int, span_id int, ord int, text string")
    texts = spark.createDataFrame([(1, 0, 1, "total 12.00"), (1, 0, 2, "xyz")], "docid long, page int, span_id int, extracted string")
    words = spark.createDataFrame([(1, 0, 1, ["total"]), (1, 0, 2, ["amount"])], "docid long, page int, span_id int, words array<string>")
    got = {r.span_id: (r.ord, r.score) for r in align.verify(some, texts, words).collect()}
    assert got[1] == (1, 1.0) and got[2][0] == 0


def test_regions(spark):
    values = spark.createDataFrame([(1, 0, 1, "ACME"), (1, 0, 2, "zzzz")], "docid long, page int, vid int, value string")
    regions = spark.createDataFrame([(1, 0, 0, "to ACME Ltd"), (1, 0, 1, "ACME")], "docid long, page int, ord int, text string")
    assert [(r.vid, r.ord, r.ratio) for r in align.fuzzy_region(values, regions).collect()] == [(1, 0, 100.0)]


def test_classifier(spark):
    from pyspark.ml.linalg import Vectors

    r = random.Random(3)
    rows = [(Vectors.dense([r.gauss(y * 3, 1), r.random()]), float(y)) for y in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(rows, ["features", "label"])
    scored = learning.score(df, learning.train(df))
    right = scored.where("(p >= 0.5) = (label = 1)").count()
    assert right >= 70
    assert learning.train(df.where("label = 0")) is None
    assert learning.score(df, None).first().p == 0.5


def test_equal_runs_are_the_first_and_shortest():
    r = random.Random(6)
    for _ in range(500):
        parts = ["".join(r.choices("ab", k=r.randint(0, 2))) for _ in range(r.randint(0, 8))]
        want = "".join(r.choices("ab", k=r.randint(1, 4)))
        runs = [(i, i + n - 1) for i in range(len(parts)) for n in range(1, min(4, len(parts) - i) + 1) if "".join(parts[i : i + n]) == want]
        assert align._equal(parts, want, 4) == (tuple(range(runs[0][0], runs[0][1] + 1)) if runs else None)
