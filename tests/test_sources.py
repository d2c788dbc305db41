import json

from pyspark.sql import functions as F

from pagefold.functions import catalog
from pagefold.sources import parsing
from pagefold.streaming import incremental


def one(spark, raw):
    return spark.createDataFrame([(1, 0, raw)], "docid long, page int, raw string")


def test_answers(spark):
    good = {"fields": [{"fieldtype": "iban", "text": "x", "word_ids": [1, 2]}, {"fieldtype": "nonsense"}, {"fieldtype": "bic", "score": 0.5}]}
    for raw in (json.dumps(good), f"```json\n{json.dumps(good)}\n```"):
        assert [(r.fieldtype, r.score) for r in parsing.answers(one(spark, raw), catalog.KILE).collect()] == [("iban", 0.8), ("bic", 0.5)]
    for raw in ("", None, "[1", "no json", "{}"):
        assert parsing.answers(one(spark, raw), catalog.KILE).count() == 0


def test_grounded(spark):
    raw = json.dumps({"iban": {"text": "a", "bbox_2d": [0, 500, 1000, 250]}, "bic": [{"text": "b", "bbox_2d": [1, 2, 3, 4]}, {"text": "c"}], "other": {"text": "d", "bbox_2d": [1, 2, 3, 4]}})
    got = sorted((r.fieldtype, r.text, r.l, r.t) for r in parsing.grounded(one(spark, raw), catalog.KILE).collect())
    assert got == [("bic", "b", 0.001, 0.002), ("iban", "a", 0.0, 0.5)]


def test_salvage_and_lenient(spark):
    df = one(spark, '{"a": "1", "b": "", "a": "2", "c": "3"').select(parsing.salvaged(F.col("raw")).alias("m"))
    assert df.first().m == {"a": "2", "c": "3"}
    for raw, want in (('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('x {"a": 1} y', '{"a": 1}'), ("none", "{}")):
        assert one(spark, raw).select(parsing.lenient(F.col("raw"))).first()[0] == want


def test_verdicts(spark):
    rows = [(1, 0, '{"verdict": "reject", "confidence": 0.9}', [1]), (1, 1, '{"verdict": "correct", "word_ids": [7]}', [1]), (1, 2, "broken", [1]), (1, 3, '{"verdict": "correct", "word_ids": [1, 7], "confidence": 0.7}', [1])]
    df = spark.createDataFrame(rows, "docid long, ord int, raw string, valid array<int>")
    got = [(r.verdict, r.ids, r.confidence) for r in parsing.verdicts(df).orderBy("ord").collect()]
    assert got == [("reject", [], 0.9), ("accept", [], 0.5), ("accept", [], 0.5), ("correct", [1], 0.7)]


def test_ocr(spark):
    box = [[0.1, 0.2], [0.3, 0.4]]
    words = [{"value": "a", "geometry": [[0, 0], [1, 1]], "snapped_geometry": box}, {"value": "skipped"}, {"value": "b", "geometry": box}]
    raw = json.dumps({"pages": [{"blocks": [{"lines": [{"words": words}]}]}, {"blocks": []}]})
    got = [(r.word_id, r.text, r.left, r.bottom) for r in parsing.ocr_words(one(spark, raw)).orderBy("word_id").collect()]
    assert got == [(0, "a", 0.1, 0.4), (1, "b", 0.1, 0.4)]
    plain = parsing.ocr_words(parsing.without_snapped(one(spark, raw))).orderBy("word_id").collect()
    assert [(r.text, r.left) for r in plain] == [("a", 0.0), ("b", 0.1)]


def test_tables(spark):
    html = "<table><tr><th>Item<th>Qty</tr><tr><td>a &amp; b</td><td> 2 </td></tr></table>"
    got = sorted(tuple(r) for r in parsing.table_cells(spark.createDataFrame([(1, html), (2, None)], "docid long, html string")).collect())
    assert (1, 1, 0, "a & b") in got and (1, 1, 1, "2") in got


def test_training_json(spark):
    df = spark.createDataFrame([(1, 0, 0, "iban", 0.1, 0.2, 0.3999, 0.4), (1, 0, 1, "bic", 0.0, 0.0, 1.0, 1.0), (1, 0, 2, "bic", 0.5, 0.5, 1.0, 1.0)], "docid long, page int, ord int, fieldtype string, left double, top double, right double, bottom double")
    assert json.loads(parsing.training_jsonl(df).first().json) == {"iban": [100, 200, 399, 400], "bic": [[0, 0, 1000, 1000], [500, 500, 1000, 1000]]}


def test_a_second_run_adds_nothing(spark, tmp_path):
    sink = str(tmp_path / "sink")
    docs = spark.range(10).withColumnRenamed("id", "docid")
    assert incremental.append_new(docs.where("docid < 6"), sink, lambda df: df) == 6
    assert incremental.append_new(docs, sink, lambda df: df) == 4
    assert incremental.append_new(docs, sink, lambda df: df) == 0
    assert incremental.results(spark, sink).count() == 10


def test_stream(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for _ in range(2):
        spark.range(5).withColumnRenamed("id", "docid").write.mode("append").parquet(source)
        incremental.follow(spark, source, "docid long", sink, mark, lambda df: df).awaitTermination()
    assert incremental.results(spark, sink).count() == 5
