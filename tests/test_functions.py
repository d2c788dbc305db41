from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pagefold.functions import geometry as g
from pagefold.functions import text, validators


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_parse_amount(spark):
    rows = ["1.234,56", "1,234", "1,23", "1.234", "1,234.56", "EUR 1234", "€ 1.234,56", " ", None, "1e5", "-7,5", "abc"]
    assert values(spark, text.parse_amount(F.col("x")), rows) == [1234.56, 1234.0, 1.23, 1.234, None, None, 1234.56, None, None, 1e5, -7.5, None]


def test_iban(spark):
    rows = ["GB29NWBK60161331926819", "GB00NWBK60161331926819", "de89 3704 0044 0532 0130 00", "", "XX", "GB29NWBK6016133192681é"]
    assert values(spark, validators.iban(F.col("x")), rows) == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def test_unknown_types_and_null_text_pass(spark):
    rows = ["x", None, ""]
    assert values(spark, validators.format_confidence(F.lit("vendor_name"), F.col("x")), rows) == [1.0] * 3
    assert values(spark, validators.format_confidence(F.lit("bic"), F.col("x")), rows) == [0.0, 1.0, 0.0]


def test_normal_forms(spark):
    assert values(spark, text.align_text("x"), ["Ünï-Code, ﬁne!", None, "  a\tb "]) == ["uni code fine", None, "a b"]
    assert values(spark, text.ocr_code(F.col("x")), ["O l 1", "Ｏｌ"]) == ["011", "01"]
    assert values(spark, text.collapse(F.col("x")), [" a   b\n"]) == ["a b"]


def test_likeness(spark):
    df = spark.createDataFrame([("abcd", "bcda"), ("x" * 250, "x" * 240 + "y"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(text.sequence_ratio("a", "b")).collect()]
    assert got[:2] == [SequenceMatcher(None, "abcd", "bcda").ratio(), SequenceMatcher(None, "x" * 250, "x" * 240 + "y").ratio()] and got[2] is None
    assert text.best_part("abc", "xxabcxx") == 100.0 and text.best_part("", "") == 100.0 and text.best_part("", "a") == 0.0


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "l double, t double, r double, b double, l2 double, t2 double, r2 double, b2 double")
    a, b = g.box("", ("l", "t", "r", "b")), g.box("", ("l2", "t2", "r2", "b2"))
    rows = df.select(g.iou(a, b).alias("iou"), g.overlap_fraction(a, b).alias("part")).collect()
    assert [(round(r.iou, 6), r.part) for r in rows] == [(round(1 / 7, 6), 0.25), (0.0, 0.0), (0.0, 0.0)]
    p = spark.createDataFrame([([10.0, 20.0, 30.0, 20.0, 30.0, 60.0, 10.0, 60.0],)], "p array<double>").select(g.polygon_box(F.col("p"), 100.0, 100.0).alias("b")).first().b
    assert tuple(p) == (0.1, 0.2, 0.3, 0.6)
    assert values(spark, g.to_thousand(F.col("x")), [0.0005, 0.0015, 0.9999], "double") == [0, 2, 1000]
    assert values(spark, g.to_thousand_cut(F.col("x")), [0.0005, 0.0015, 0.9999], "double") == [0, 1, 999]
