"""Commands: merge prediction files, score them, and make fields of recorded answers.

    python -m pagefold merge OUT FILE FILE ... [--mode weighted_max] [--iou 0.5]
    python -m pagefold extract OUT ANSWERS WORDS [--no-refiner] [--guard] [--no-validator]
    python -m pagefold eval PREDICTIONS GOLD WORDS

Prediction files are JSON, {docid: [field]}; answers (docid, page, raw) and words are Parquet.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.operators import ensemble, evaluate
from pagefold.settings import Settings, fields
from pagefold.sources import parsing

SIDES = {"left": "l", "top": "t", "right": "r", "bottom": "b"}


def _predictions(spark: SparkSession, path: str, k: int = 0) -> DataFrame:
    rows = parsing.predictions(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))
    return rows.withColumnsRenamed(SIDES | {"ord": "pos", "line_item_id": "li"}).withColumn("k", F.lit(k)).withColumn("pos", F.col("pos").cast("long")).select("docid", "fieldtype", "page", "li", "k", "pos", "l", "t", "r", "b", F.coalesce("score", F.lit(1.0)).alias("score"))


def _as_json(rows: DataFrame) -> DataFrame:
    named = rows.withColumnsRenamed({b: a for a, b in SIDES.items()} | {"li": "line_item_id"})
    return parsing.prediction_json(named.withColumn("text", F.lit(None).cast("string")))


def main(args: list[str] | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="pagefold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    merge = commands.add_parser("merge")
    merge.add_argument("out")
    merge.add_argument("files", nargs="+")
    merge.add_argument("--mode", default="weighted_max", choices=ensemble.MODES)
    merge.add_argument("--iou", type=float, default=0.5)
    extract = commands.add_parser("extract")
    for name in ("out", "answers", "words"):
        extract.add_argument(name)
    extract.add_argument("--no-refiner", action="store_true")
    extract.add_argument("--guard", action="store_true")
    extract.add_argument("--no-validator", action="store_true")
    score = commands.add_parser("eval")
    for name in ("predictions", "gold", "words"):
        score.add_argument(name)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "merge":
        every = reduce(DataFrame.unionByName, [_predictions(spark, f, k) for k, f in enumerate(a.files)])
        merged = ensemble.merge(every, len(a.files), threshold=a.iou, mode=a.mode)
        out = _as_json(merged.withColumn("ord", F.struct("fieldtype", "page", "li", "g")))
        out.write.mode("overwrite").parquet(a.out)
        return out
    words = spark.read.parquet(a.words)
    if a.command == "extract":
        found = fields(spark.read.parquet(a.answers), words, Settings(not a.no_refiner, a.guard, not a.no_validator))
        found.write.mode("overwrite").parquet(a.out)
        return found
    gold = _predictions(spark, a.gold)
    scores = evaluate.run(_predictions(spark, a.predictions), gold, words, words.select("docid"))
    scores.show(truncate=False)
    return scores


if __name__ == "__main__":
    main()
