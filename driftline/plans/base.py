"""Registration of a module's queries, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Plans:
    """Queries by name, and the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(run):
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return run

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which a cluster shares; a temporary folder where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written once to the shared folder and read from there, for one that several steps read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(column: str | Column) -> Column:
    """Epoch microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"), F.current_timezone()))


def rounded(column: str | Column, digits: int = 4) -> Column:
    return F.bround(column, digits)
