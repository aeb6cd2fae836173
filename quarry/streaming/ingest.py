"""Incremental indexing: new source files arrive as a stream and are extracted in small batches. An extension;
a file stream does not see that a known path has changed, which Index.update() is for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.extract.stage import extract_files
from quarry.sources import scan


def extraction_stream(spark: SparkSession, root: str, table: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Extract what is new under a folder, files_per_batch at a time, into a Parquet table with a column batch; runs until all is read."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[rR][sS],[cC][sS]}").option("maxFilesPerTrigger", files_per_batch)
    source = source.schema("path string, modificationTime timestamp, length long, content binary").load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.element_at(F.split("path", base, 2), -1)
    rows = source.select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), "content")
    rows = rows.where(~scan.is_skipped(F.col("path"))).withColumn("language", scan.language(F.col("path")))

    def write(batch: DataFrame, number: int) -> None:
        good, _ = scan.split_valid(batch)
        extract_files(good).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The rows of each file's last batch."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"]).drop("batch")
