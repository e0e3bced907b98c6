"""Tables in the folder that the cluster shares, and small helpers for all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a temporary one in local mode, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it again, so that a lost executor costs no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks a side for broadcast if it has at most so many rows; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def remainder(column: str, modulus: int):
    """crc32 of an id's text, modulo a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: Row numbers (8 bytes each) up to this number are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Rows with a unique number, written once: numbers made anew at each read follow the splits of files, which follow the cores
    alive when a read is planned, so after a lost executor they would name other rows."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd")


def without_rows(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose numbers are in the one-column table ``dropped``; texts move only if the numbers are too many to broadcast."""
    dropped = written(dropped, "dropped")
    return docs.join(small_or_shuffled(dropped, dropped.count(), BROADCAST_ROWS), name, "left_anti")
