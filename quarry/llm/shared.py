"""Session helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a local master alone has a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quarry-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def drop_kept(*tables: DataFrame) -> None:
    """Delete tables of kept() that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of at most so many rows are broadcast to a join; longer lists are shuffled.
SMALL = 2_000_000


def by_keys(df: DataFrame, keys: DataFrame, on: Column, how: str) -> DataFrame:
    """A left_semi or left_anti join to a kept table of keys, which is counted first and broadcast if it is short: df is not shuffled then."""
    return df.join(F.broadcast(keys) if keys.count() <= SMALL else keys, on, how)


def named(*names: str) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


#: What operators keep in a worker from one task to the next, by operator.
HELD: dict[str, dict] = {}


def trim(keep: str | None = None) -> None:
    """Drop what other operators keep in this worker, and give freed memory back to the system, where the C library can."""
    for name, held in HELD.items():
        if name != keep:
            held.clear()
    gc.collect()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def letters_lower(column):
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_groups(batches: Iterator[pd.DataFrame], key: str, least: int) -> Iterator[pd.DataFrame]:
    """Regroup batches that are sorted by key into frames of at least so many rows that never split a key."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        frame = pd.concat(held, ignore_index=True)
        values = frame[key].to_numpy()
        cut = int((values != values[-1]).sum()) if values[0] != values[-1] else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
            frame = frame.iloc[cut:].reset_index(drop=True)
        held, rows = [frame], len(frame)
    if held:
        yield pd.concat(held, ignore_index=True)
