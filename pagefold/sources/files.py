"""Folders of files: splits, documents with both files, page images, archives of vectors, rule tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import geometry as g
from pagefold.sources import parsing

SPLITS = ("train", "val", "test", "trainval")
ANNOTATION = "struct<field_extractions:array<struct<fieldtype:string,page:int,bbox:array<double>,text:string,line_item_id:int>>,line_item_extractions:array<struct<fieldtype:string,page:int,bbox:array<double>,text:string,line_item_id:int>>,metadata:struct<cluster_id:int>>"


def split(spark: SparkSession, root: str, table: str, name: str) -> DataFrame:
    """A table's rows of a split (a column that the folder is partitioned by, so only its files are read); trainval is train and val."""
    if name not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return spark.read.parquet(f"{root}/{table}").where(F.col("split").isin(["train", "val"] if name == "trainval" else [name]))


def annotated_fields(files: DataFrame) -> DataFrame:
    """docid, cluster, ord, fieldtype, page, left, top, right, bottom, text, line_item_id of annotation files (docid, raw): page-level fields, then those of rows. Fields without box, type or page are skipped; a row's field without an id has 0, a text that is missing is "". Files that do not parse give nothing."""
    a = F.from_json("raw", ANNOTATION)
    listed = lambda c, li: F.transform(F.coalesce(c, F.array().cast("array<struct<fieldtype:string,page:int,bbox:array<double>,text:string,line_item_id:int>>")), lambda f: F.struct(f["fieldtype"].alias("fieldtype"), f["page"].alias("page"), f["bbox"].alias("bbox"), F.coalesce(f["text"], F.lit("")).alias("text"), li(f).alias("line_item_id")))
    both = F.concat(listed(F.col("a.field_extractions"), lambda f: F.lit(None).cast("int")), listed(F.col("a.line_item_extractions"), lambda f: F.coalesce(f["line_item_id"], F.lit(0))))
    rows = files.withColumn("a", a).where("a is not null").select("docid", F.col("a.metadata.cluster_id").alias("cluster"), F.posexplode(both).alias("ord", "f"))
    good = rows.where("f.fieldtype is not null and f.page is not null and size(f.bbox) = 4")
    return good.select("docid", "cluster", "ord", "f.fieldtype", "f.page", *(F.col("f.bbox")[k].alias(n) for k, n in enumerate(g.SIDES)), "f.text", "f.line_item_id")


def records(ocr: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, annotated fields) of the documents of which both files (docid, raw) parse."""
    both = parsing.documents(ocr, annotations).select("docid", "ocr", "annotation")
    return parsing.ocr_words(both.select("docid", F.col("ocr").alias("raw"))), annotated_fields(both.select("docid", F.col("annotation").alias("raw")))


def page_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """docid, page, content (base64) of image files named docid-page; rasterising is left to whoever writes them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select(F.regexp_extract(name, r"^(.*)-\d+$", 1).alias("docid"), F.regexp_extract(name, r"-(\d+)$", 1).cast("int").alias("page"), F.base64("content").alias("content"))


def vector_archives(spark: SparkSession, path: str) -> DataFrame:
    """docid, cluster, embedding of NumPy archives with the arrays embeddings, cluster_ids and docids, each read by one task."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for content in b.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as f:
                    yield pd.DataFrame({"docid": [str(x) for x in f["docids"]], "cluster": f["cluster_ids"].astype(int), "embedding": list(f["embeddings"].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "docid string, cluster int, embedding array<float>")


def archive(vectors: DataFrame) -> DataFrame:
    """content: one archive for each partition of vectors (docid, cluster, embedding), as vector_archives reads; write it with a binary sink, or collect it where it is small."""

    def pack(batches: Iterator) -> Iterator:
        import pandas as pd

        some = [b for b in batches if len(b)]
        if some:
            whole, out = pd.concat(some), io.BytesIO()
            np.savez(out, embeddings=np.array(whole.embedding.tolist(), np.float32), cluster_ids=whole.cluster.to_numpy(np.int32), docids=whole.docid.to_numpy(str))
            yield pd.DataFrame({"content": [out.getvalue()]})

    return vectors.select("docid", "cluster", "embedding").mapInPandas(pack, "content binary")


def with_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """docs whose cluster has a rule."""
    return docs.join(rules.select("cluster").distinct(), "cluster", "left_semi")
