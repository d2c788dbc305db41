import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pagefold.operators import analysis, ensemble, joins, providers, rows, spans

FIELDS = "docid long, fieldtype string, page int, li int, k int, pos long, l double, t double, r double, b double, score double"


def fields(spark, *some):
    base = {"docid": 1, "fieldtype": "iban", "page": 0, "li": None, "k": 0, "pos": 1, "l": 0.0, "t": 0.0, "r": 2.0, "b": 2.0, "score": 0.8}
    return spark.createDataFrame([tuple((base | x).values()) for x in some], FIELDS)


def test_equal_boxes_collapse(spark):
    out = ensemble.merge(fields(spark, {}, {"k": 1, "score": 0.9}), 2).collect()
    assert [(r.score, r.n_sources) for r in out] == [(0.9, 2)]
    mean = ensemble.merge(fields(spark, {}, {"k": 1, "score": 0.9}), 2, [1.0, 3.0], mode="weighted_mean").first()
    assert mean.score == pytest.approx((0.8 + 2.7) / 4)


def test_what_keeps_fields_apart(spark):
    for other in ({"page": 1}, {"fieldtype": "bic"}, {"li": 3}, {"l": 50.0, "r": 52.0}):
        assert ensemble.merge(fields(spark, {}, {"k": 1} | other), 2).count() == 2
    assert ensemble.merge(fields(spark, {"li": 3}, {"k": 1, "li": 3}), 2).count() == 1


def test_a_bridge_joins_the_first_group_only(spark):
    some = fields(spark, {"r": 10.0}, {"pos": 2, "l": 4.0, "r": 14.0}, {"pos": 3, "l": 2.0, "r": 12.0})
    got = ensemble.clustered(some, ["docid", "fieldtype", "page"], ["k", "pos"]).orderBy("pos")
    assert [r.g for r in got.collect()] == [0, 1, 0]


def test_votes(spark):
    out = ensemble.merge(fields(spark, {}, {"k": 1}), 3, mode="vote").first()
    assert out.score == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        ensemble.merge(fields(spark, {}), 2, [1.0])
    with pytest.raises(ValueError):
        ensemble.merge(fields(spark, {}), 1, mode="sum")


def test_first_of_equals_stays(spark):
    out = ensemble.best_of_page(fields(spark, {}, {"pos": 2}, {"pos": 3, "li": 1}), []).select("pos").collect()
    assert sorted(r.pos for r in out) == [1, 3]


def page(spark, *texts, top=0.1):
    rows_ = [(1, 0, i, x, 0.05 + 0.1 * i, top, 0.1 + 0.1 * i, top + 0.02) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows_, "docid long, page int, word_id int, text string, left double, top double, right double, bottom double")


def test_rows_are_anchored(spark):
    df = spark.createDataFrame([(1, 0, i, "w", 0.1 * i, t, 0.1 * i + 0.05, t + 0.01) for i, t in enumerate([0.1, 0.108, 0.116, 0.124, 0.132])], "docid long, page int, word_id int, text string, left double, top double, right double, bottom double")
    assert [r.row for r in rows.row_groups(df).orderBy("word_id").collect()] == [0, 0, 1, 1, 2]


def test_longest_run(spark):
    df = spark.createDataFrame([([1, 2, 5, 6, 7, 9],), ([3, 4, 1, 2],), ([5],), ([9, 1, 2, 9],)], "x array<int>")
    assert [r[0] for r in df.select(rows.longest_run(F.col("x"))).collect()] == [[5, 6, 7], [3, 4, 1, 2], [5], [1, 2]]


def test_windows(spark):
    got = {(r.start, r.n): r.spaced for r in rows.windows(page(spark, "a", "b", "c"), 2).collect()}
    assert got == {(0, 1): "a", (0, 2): "a b", (1, 1): "b", (1, 2): "b c", (2, 1): "c"}


def test_unknown_words_are_ignored(spark):
    some = spark.createDataFrame([(1, 0, 7, [0, 9]), (1, 0, 8, [9])], "docid long, page int, span_id int, word_ids array<int>")
    out = joins.union_of_words(some, page(spark, "a", "b"), ["span_id"]).collect()
    assert [(r.span_id, r.text) for r in out] == [(7, "a")]


def test_find_span():
    words = "invoice no 12345 date 2024".split()
    assert spans.find_span("no 12345", words) == (1, 2, 1.0)
    assert spans.find_span("zzz", words) is None


def test_find_span_passes_over_no_better_run():
    r = random.Random(3)
    for _ in range(300):
        words = ["".join(r.choices("abé1", k=r.randint(1, 4))) for _ in range(r.randint(0, 14))]
        query = " ".join("".join(r.choices("abé1", k=r.randint(1, 4))) for _ in range(r.randint(1, 4)))
        best, q = None, len(query.split())
        for n in range(max(1, q - 2), q + 3):
            for i in range(len(words) - n + 1):
                ratio = SequenceMatcher(None, query, " ".join(words[i : i + n])).ratio()
                if best is None or ratio > best[2]:
                    best = i, i + n - 1, ratio
        assert spans.find_span(query, words, 0.6) == (best if best and best[2] >= 0.6 else None)


def test_nearest_in_blocks(spark):
    r = random.Random(4)
    x = [(i, [float(r.randint(-3, 3)) for _ in range(4)], "ab"[i % 2]) for i in range(60)]
    index = spark.createDataFrame(x, "id long, vector array<double>, label string")
    queries = index.where("id < 20").select(F.col("id").alias("query"), "vector")
    got = {(n.query, n["rank"]): n.id for n in analysis.nearest(queries, index, 3, block=4).collect()}
    for i, q, _ in x[:20]:
        order = sorted((-sum(map(float.__mul__, q, e)), k) for k, e, _ in x if k != i)
        assert [got[i, n] for n in (1, 2, 3)] == [k for _, k in order[:3]]
    assert analysis.nearest(queries.limit(0), index, 3).count() == 0


def test_gates(spark):
    a, b = (spark.createDataFrame([(n, x) for n, x in zip("pqrs", xs, strict=True)], "name string, v double") for xs in ((1.0, 1.0, 1.0, 1.0), (2.5, 1.5, 1.0, 0.5)))
    assert {r.name: r.verdict for r in analysis.gate(a, b, ["name"], "v").collect()} == {"p": "strong", "q": "good", "r": "neutral", "s": "worse"}


def test_providers(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ConnectionError
        return prompt.upper()

    assert providers.Retry(first=0).call(flaky, "x", lambda s: None) == "X" and len(calls) == 3
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "docid long, page int, prompt string")
    assert {r.raw for r in providers.completed(df, lambda: str.upper).collect()} == {"A", "B"}
    assert providers.recorded(df, spark.createDataFrame([(1, 0, "r")], "docid long, page int, raw string")).where("raw is null").count() == 1
