import io
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefold import settings
from pagefold.__main__ import main
from pagefold.operators import align, analysis, evaluate, joins, providers
from pagefold.sources import files, parsing
from pagefold.streaming import incremental

WORDS = "docid string, page int, word_id int, text string, left double, top double, right double, bottom double"


def page(spark, *texts):
    return spark.createDataFrame([("d", 0, i, t, 0.1 * i, 0.1, 0.1 * i + 0.05, 0.12) for i, t in enumerate(texts)], WORDS)


def test_runs_can_be_repeated(spark, tmp_path):
    """Keys without rows are done too; a run that stops half-way does not count."""
    sink, calls = str(tmp_path / "sink"), []

    def work(df):
        calls.append(sorted(r.docid for r in df.select("docid").collect()))
        return df.where("docid <> 2").withColumn("y", F.col("docid") * 10)

    docs = spark.createDataFrame([(1,), (2,), (3,)], "docid long")
    assert incremental.append_new(docs, sink, work) == 3
    assert incremental.append_new(docs, sink, work) == 0

    def broken(df):
        return work(df).withColumn("z", F.raise_error(F.lit("stop")))

    more = docs.union(spark.createDataFrame([(4,)], "docid long"))
    with pytest.raises(Exception, match="stop"):
        incremental.append_new(more, sink, broken)
    work(more.where("docid = 4")).write.parquet(f"{sink}/rows/run=halfway")
    assert incremental.append_new(more, sink, work) == 1
    assert sorted((r.docid, r.y) for r in incremental.results(spark, sink).collect()) == [(1, 10), (3, 30), (4, 40)]
    assert calls[0] == [1, 2, 3] and calls[-1] == [4]


def test_following_a_folder(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in (1, 2):
        spark.createDataFrame([(k,), (3,)], "docid long").write.mode("append").parquet(source)
        incremental.follow(spark, source, "docid long", sink, str(tmp_path / "mark"), lambda df: df).awaitTermination(60)
    assert sorted(r.docid for r in incremental.results(spark, sink).distinct().collect()) == [1, 2, 3]


def test_user_programs(spark):
    words = page(spark, "Total", "12", "EUR")

    def program(ws):
        return [{"fieldtype": "amount_due", "word_ids": [w["word_id"] for w in ws if w["text"].isdigit()]}, {"fieldtype": "unknown", "word_ids": [0]}, {"fieldtype": "iban", "word_ids": ["1"]}, 7]

    got = align.run_program(words, program, ["amount_due", "iban"]).collect()
    assert [(r.fieldtype, r.word_ids) for r in got] == [("amount_due", [1])]
    assert align.run_program(words, lambda ws: 1 / 0, ["iban"]).count() == 0
    assert align.run_program(words, lambda ws: time.sleep(3) or [], ["iban"], seconds=0.2).count() == 0
    kept = align.verified_by(words, lambda df: df.where("word_id > 0"), lambda df: df.where("text <> 'EUR'"))
    assert [r.text for r in kept.collect()] == ["12"]


def test_verification_with_choices(spark):
    keys = "docid long, page int, span_id int"
    some = spark.createDataFrame([(1, 0, 1, 0, "abc"), (1, 0, 1, 1, "xyz"), (1, 0, 2, 0, "total"), (1, 0, 2, 1, "q")], f"{keys}, ord int, text string")
    texts = spark.createDataFrame([(1, 0, 1, "a--"), (1, 0, 2, "total")], f"{keys}, extracted string")
    words = spark.createDataFrame([(1, 0, 1, ["w"]), (1, 0, 2, ["total"])], f"{keys}, words array<string>")
    choices = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 1)], f"{keys}, choice int")
    assert {r.span_id: r.ord for r in align.verify(some, texts, words, choices).collect()} == {1: 1, 2: 0}
    assert {r.span_id: r.ord for r in align.verify(some, texts, words).collect()} == {1: 0, 2: 0}


def test_files(spark, tmp_path):
    ocr = {"pages": [{"page_idx": 0, "blocks": [{"lines": [{"words": [{"value": "a", "geometry": [[0, 0], [1, 1]]}, {"value": "gone"}, {"value": "b", "geometry": [[0, 0], [1, 1]], "snapped_geometry": [[0.5, 0], [1, 1]]}]}]}]}]}
    note = {"field_extractions": [{"fieldtype": "iban", "page": 0, "bbox": [0, 0, 1, 1]}, {"fieldtype": "bic", "page": 0}], "line_item_extractions": [{"fieldtype": "line_item_code", "page": 0, "bbox": [0, 0, 1, 1], "text": "x"}], "metadata": {"cluster_id": 7}}
    raw = lambda *rows: spark.createDataFrame(rows, "docid string, raw string")
    words, fields = files.records(raw(("d", json.dumps(ocr)), ("e", "{broken"), ("f", json.dumps(ocr))), raw(("d", json.dumps(note)), ("e", json.dumps(note))))
    assert [(r.docid, r.word_id, r.text, r.left) for r in words.orderBy("word_id").collect()] == [("d", 0, "a", 0.0), ("d", 1, "b", 0.5)]
    assert [(r.cluster, r.fieldtype, r.text, r.line_item_id) for r in fields.orderBy("ord").collect()] == [(7, "iban", "", None), (7, "line_item_code", "x", 0)]
    spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "docid string, split string").write.partitionBy("split").parquet(str(tmp_path / "docs"))
    assert {r.docid for r in files.split(spark, str(tmp_path), "docs", "trainval").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="split"):
        files.split(spark, str(tmp_path), "docs", "dev")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "doc-1-0.png").write_bytes(b"png")
    assert [(r.docid, r.page, r.content) for r in files.page_images(spark, str(tmp_path / "img")).collect()] == [("doc-1", 0, "cG5n")]


def test_vector_archives(spark, tmp_path):
    vectors = spark.createDataFrame([("a", 1, [0.5, 1.0]), ("b", 2, [2.0, 3.0])], "docid string, cluster int, embedding array<float>").coalesce(1)
    content = files.archive(vectors).first().content
    assert list(np.load(io.BytesIO(bytes(content)))["docids"]) == ["a", "b"]
    (tmp_path / "v.npz").write_bytes(bytes(content))
    assert sorted(map(tuple, files.vector_archives(spark, str(tmp_path / "v.npz")).collect())) == [("a", 1, [0.5, 1.0]), ("b", 2, [2.0, 3.0])]


def test_settings_and_commands(spark, tmp_path):
    words = page(spark, "Vendor:", "Acme", "Ltd", "x9")
    answer = {"fields": [{"fieldtype": "vendor_name", "text": "Acme Ltd", "word_ids": [0, 1, 2]}, {"fieldtype": "amount_due", "text": "zz", "word_ids": [3], "score": 0.5}]}
    responses = spark.createDataFrame([("d", 0, json.dumps(answer)), ("e", 0, "none")], "docid string, page int, raw string")
    got = {r.fieldtype: (round(r.l, 2), r.score) for r in settings.fields(responses, words).collect()}
    assert got == {"vendor_name": (0.1, 0.8), "amount_due": (0.3, 0.0)}
    plain = {r.fieldtype: (round(r.l, 2), r.score) for r in settings.fields(responses, words, settings.Settings(refiner=False, validator=False)).collect()}
    assert plain == {"vendor_name": (0.0, 0.8), "amount_due": (0.3, 0.5)}
    field = {"fieldtype": "iban", "page": 0, "bbox": [0.0, 0.0, 0.2, 0.2], "score": 0.9}
    for name, score in (("one", 0.9), ("two", 0.4)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"d": [field | {"score": score}]}))
    merged = main(["merge", str(tmp_path / "out"), str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert json.loads(merged.first().json)[0]["score"] == 0.9
    words.write.parquet(str(tmp_path / "words"))
    scores = {r.task: (r.hits, r.n_gold) for r in main(["eval", str(tmp_path / "one.json"), str(tmp_path / "two.json"), str(tmp_path / "words")]).collect()}
    assert scores == {"kile": (1, 1), "lir": (0, 0)}


def test_passes(spark):
    amounts = spark.createDataFrame([(1, p, t, x, 0.5, k) for k, (p, t, x) in enumerate([(0, "amount_total_net", "100"), (0, "amount_total_tax", "20"), (0, "amount_total_gross", "150"), (0, "iban", "x"), (1, "amount_total_net", "1")])], "docid long, page int, fieldtype string, text string, score double, pos int")
    bad = analysis.calc_check(amounts).where("off")
    new = lambda gross: spark.createDataFrame([(1, 0, t, x, 1.0, 9) for t, x in (("amount_total_net", "100"), ("amount_total_tax", "20"), ("amount_total_gross", gross))], amounts.schema)
    good = evaluate.replace_amounts(amounts, bad, new("120")).collect()
    assert sorted((r.fieldtype, r.pos) for r in good) == [("amount_total_gross", 9), ("amount_total_net", 4), ("amount_total_net", 9), ("amount_total_tax", 9), ("iban", 3)]
    assert sorted(r.pos for r in evaluate.replace_amounts(amounts, bad, new("150")).collect()) == [0, 1, 2, 3, 4]
    tries = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 0.9), (1, 3, "c", 1.0), (2, 1, "d", 0.3), (2, 2, "e", 0.3)], "cluster int, try int, program string, recall double")
    assert {r.cluster: (r.program, r.n) for r in providers.best_program(tries).collect()} == {1: ("b", 2), 2: ("e", 2)}
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 1)], "docid long, ord int, n_items long")
    assert [r["first"] for r in providers.row_offsets(rows).orderBy("ord").collect()] == [0, 2, 5]
    assert providers.batched_keys(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]


def test_embedding_first_pages(spark):
    pages = spark.createDataFrame([("a", 0, "xx"), ("a", 1, "yy"), ("b", 0, "zzz")], "docid string, page int, content string")
    got = {r.docid: r.embedding for r in providers.embedded(pages, lambda: lambda xs: [[3.0, 4.0] for _ in xs]).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.6, 0.8]}
    assert providers.embedded(pages, lambda: lambda xs: [][0 if xs else 1 :] or (_ for _ in ()).throw(ValueError)).count() == 0


def test_likest_sets_against_brute_force(spark):
    import random

    r = random.Random(61)
    tokens = [f"t{k}" for k in range(30)] + ["the"]
    q = {k: {"the", *r.sample(tokens, r.randint(1, 8))} if k % 3 else {f"q{k}", "the"} for k in range(12)}
    x = {k: {"the", *r.sample(tokens, r.randint(1, 12))} for k in range(60)}
    flat = lambda s, name: spark.createDataFrame([(k, t) for k, ts in s.items() for t in sorted(ts)], f"{name} int, token string")
    for k in (1, 3):
        got = sorted((a.query, a.id, round(a.jaccard, 9)) for a in analysis.jaccard(flat(q, "query"), flat(x, "id"), k).collect())
        want = []
        for i, s in q.items():
            best = sorted(((-len(s & y) / len(s | y), j) for j, y in x.items() if s & y))[:k]
            want += [(i, j, round(-v, 9)) for v, j in best]
        assert got == sorted(want)


def test_nearest_vectors_against_brute_force(spark):
    r = np.random.default_rng(7)
    e = np.round(r.normal(size=(90, 4)), 1)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(e)], "id long, vector array<double>, label int").repartition(3)
    asked = rows.where("id % 7 = 0").select(F.col("id").alias("query"), "vector")
    for block in (8192, 4):
        got = sorted((a.query, a.id, round(a.sim, 6)) for a in analysis.nearest(asked, rows, 3, block).collect())
        want = []
        for q in range(0, 90, 7):
            sims = sorted(((-round(float(e[q] @ e[i]), 6), i) for i in range(90) if i != q))[:3]
            want += [(q, i, -s) for s, i in sims]
        assert got == sorted(want)
    assert analysis.nearest(asked.limit(0), rows, 3).count() == 0


def test_cells(spark):
    words = page(spark, "7", "pcs", "x").withColumn("docid", F.lit(1))
    cells = spark.createDataFrame([(1, 0, 0, r, c, "m", 0.1 * c, 0.0, 0.1 * c + 0.09, 0.2) for r in (0, 1) for c in (0, 1, 5)], "docid int, page int, table_id int, row int, col int, text string, l double, t double, r double, b double")
    columns = spark.createDataFrame([(1, 0, 0, 0, "line_item_quantity"), (1, 0, 0, 1, None), (1, 0, 0, 5, "line_item_code")], "docid int, page int, table_id int, col int, fieldtype string")
    assert [(r.fieldtype, r.text, r.line_item_id) for r in joins.cells_on_words(cells, columns, words).collect()] == [("line_item_quantity", "7", 1)]


def test_malformed_answers(spark):
    raw = lambda *xs: spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "docid int, raw string")
    got = parsing.embedded_candidates(raw('{"candidates":[{"word_ids":[1]},{"word_ids":"x"},5,{"word_ids":[2],"score":"high"},{"text":"t"}]}', "nothing", 'so { "candidates": [{"word_ids":[3],"line_item_id":4}]}', "[1]")).collect()
    assert sorted((r.docid, r.word_ids, r.score, r.line_item_id) for r in got) == [(0, [], 0.5, None), (0, [1], 0.5, None), (2, [3], 0.5, 4)]
    got = parsing.script_output(raw('[{"fieldtype":"iban","word_ids":[1,2]},{"fieldtype":"iban","word_ids":[1.5]},{"fieldtype":"iban","word_ids":["1"]},{"fieldtype":"x","word_ids":[]},{"fieldtype":"iban"},3]', "{}", None), ["iban"]).collect()
    assert [(r.ord, r.word_ids) for r in got] == [(0, [1, 2]), (4, [])]
