"""Session helpers of the graph and resolution plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry import schema


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local master alone has a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quarry-work"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str = "step", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and a lost executor costs nothing.

    by: the last column, each value of which gets a folder of its own, so that a filter on it reads no other.
    """
    path = work_dir(df.sparkSession, what)
    if by:
        df.repartition(by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema.TABLES[relation])
