"""Batches that can be run again: what is in the sink is not done twice.

A sink is two folders: rows, each run's in a folder of its own, and done, the keys of finished runs. Keys are written after the rows, and
only rows of runs that done names are read, so a run that stops half-way leaves nothing that counts and is done again. Keys whose work gave
no rows are done as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def remaining(docs: DataFrame, done: DataFrame, key: str = "docid") -> DataFrame:
    return docs.join(done.select(key).distinct(), key, "left_anti")


def done_keys(spark: SparkSession, sink: str) -> DataFrame | None:
    """The keys that are done, with their runs; None before the first run."""
    try:
        return spark.read.parquet(f"{sink}/done")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def results(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of finished runs."""
    runs = spark.read.parquet(f"{sink}/done").select("run").distinct()
    return spark.read.parquet(f"{sink}/rows").join(F.broadcast(runs), "run", "left_semi").drop("run")  # a row for each run


def append_new(docs: DataFrame, sink: str, work: Callable[[DataFrame], DataFrame], key: str = "docid") -> int:
    """Runs work on the rows of docs that are not done and appends the result; the number of new keys."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    done = done_keys(spark, sink)
    new = (docs if done is None else remaining(docs, done, key)).persist()
    try:
        n = new.select(key).distinct().count()
        if n:
            work(new).write.parquet(f"{sink}/rows/run={run}")
            new.select(key).distinct().withColumn("run", F.lit(run)).write.mode("append").parquet(f"{sink}/done")
    finally:
        new.unpersist()
    return n


def follow(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "docid") -> StreamingQuery:
    """Reads Parquet files as they come to source, and appends work on the keys that are not done; ends when all files are read. The checkpoint keeps which are."""
    stream = spark.readStream.schema(schema).parquet(source)
    put = lambda batch, _: append_new(batch, sink, work, key) and None
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
