"""What the corpus operators share: scratch tables, batch limits, ordering over partitions."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session gets a folder of its own below the system's temporary one, and keeps it as the setting;
    on a cluster, where machines don't see each other's disks, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "getCheckpointDir", lambda: None)()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = Path(tempfile.mkdtemp(prefix="pagefold-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, under the application's id."""
    return f"{shared_folder(spark)}/pagefold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession) -> None:
    """Removes the application's scratch tables and files; results that are not yet written are lost with them."""
    folder = f"{shared_folder(spark)}/pagefold/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, kept as Parquet in the shared folder; the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, so that a batch of whole texts fits in a worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds. One pair of values for all operators: the setting is read when a lazy plan runs, not when it is built."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text a task should be given by a shuffle.
TASK_BYTES = 128 << 20


def text_partitions(docs: DataFrame, column: str = "text", least: int = 1) -> int:
    """Partitions for a shuffle of whole texts: by their bytes, so that a task's share doesn't grow with the input, and at least the session's number."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, shuffle_partitions(docs.sparkSession), -(-size // TASK_BYTES))


def positions(df: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """df range-partitioned and sorted by keys, with pid and the row's place in its partition (from 0).

    The result is written, so that both numbers stay the same when a task runs again.
    """
    n = shuffle_partitions(df.sparkSession)
    cols = [F.col(f"`{k}`") for k in keys]
    dealt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    row = F.monotonically_increasing_id()
    return written(dealt.withColumn("pid", F.shiftright(row, 33).cast("int")).withColumn(at, row.bitwiseAND(F.lit((1 << 33) - 1))), "positions")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
