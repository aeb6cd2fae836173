"""An index on disk: a folder of Parquet tables with numbered markers, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.extract.stage import EXTRACTED
from quarry.schema import TABLES, VERSION

#: What is stored: the relations, and what each file held when it was extracted, from which an update goes on.
STORED = TABLES | {"extracted": EXTRACTED}


class OutdatedIndex(RuntimeError):
    """The index was written by another version: build it anew with index --rebuild."""


def _marks(spark: SparkSession, folder: str) -> list:
    """(n, version, at) of all generations, the last one first."""
    try:
        rows = spark.read.schema("version int, at string, n long").json(f"{folder}/marks").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(((r["n"], r["version"], r["at"]) for r in rows), reverse=True)


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Write all tables to a new folder below, then a marker with the next number: readers take the greatest one, so they see the
    old index or the new one, and a run that fails midway leaves the old one."""
    spark = next(iter(tables.values())).sparkSession
    at = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{at}/{name}")
    n = max((m[0] for m in _marks(spark, folder)), default=0) + 1
    spark.createDataFrame([(VERSION, at)], "version int, at string").coalesce(1).write.json(f"{folder}/marks/n={n}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    _, version, at = next(iter(_marks(spark, folder)), (0, None, None))
    if version != VERSION:
        raise OutdatedIndex(f"the index in {folder} is of version {version}, not {VERSION}; run index --rebuild")
    return {name: spark.read.schema(schema).parquet(f"{folder}/{at}/{name}") for name, schema in STORED.items()}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete an index, in whatever store it lies."""
    _delete(spark, folder)


def remove_old(spark: SparkSession, folder: str) -> None:
    """Delete all generations but the last one."""
    for n, _, at in _marks(spark, folder)[1:]:
        _delete(spark, f"{folder}/marks/n={n}")
        _delete(spark, f"{folder}/{at}")


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables without some files (file_id) and all that hangs on them; references to their symbols go too."""
    from quarry.operators.edges import package_deps

    gone = gone.select("file_id").distinct()
    symbols = tables["symbols"].join(gone, "file_id", "left_anti")
    lost = tables["symbols"].join(gone, "file_id", "left_semi").select(F.col("id").alias("symbol_id"))
    inside = lost.withColumnRenamed("symbol_id", "in_symbol_id")
    out = dict(tables)
    out["files"] = tables["files"].join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti").select(*tables["files"].columns)
    out["symbols"] = symbols.select(*tables["symbols"].columns)
    out["refs"] = tables["refs"].join(gone, "file_id", "left_anti").join(lost, "symbol_id", "left_anti").join(inside, "in_symbol_id", "left_anti").select(*tables["refs"].columns)
    out["imports"] = tables["imports"].join(gone, "file_id", "left_anti").select(*tables["imports"].columns)
    out["attributes"] = tables["attributes"].join(lost, "symbol_id", "left_anti").select(*tables["attributes"].columns)
    for name, sides in (("call_edges", ("caller_symbol_id", "callee_symbol_id")), ("file_deps", ("from_file_id", "to_file_id"))):
        keys = lost if name == "call_edges" else gone
        for side in sides:
            out[name] = out[name].join(keys.toDF(side), side, "left_anti").select(*tables[name].columns)
    out["file_packages"] = tables["file_packages"].join(gone, "file_id", "left_anti").select(*tables["file_packages"].columns)
    out["package_deps"] = package_deps(out["file_deps"], out["file_packages"]).select(*tables["package_deps"].columns)
    if "extracted" in tables:
        out["extracted"] = tables["extracted"].join(out["files"].select("path"), "path", "left_semi").select(*tables["extracted"].columns)
    return out


def compact(tables: dict[str, DataFrame], folder: str) -> None:
    """Rewrite the tables in few files, each sorted by what is looked up in it, and delete the older generations."""
    order = {"symbols": "file_id", "refs": "file_id", "imports": "file_id", "call_edges": "callee_symbol_id", "file_deps": "to_file_id"}
    save({n: df.repartitionByRange(order[n]).sortWithinPartitions(order[n]) if n in order else df for n, df in tables.items()}, folder)
    remove_old(next(iter(tables.values())).sparkSession, folder)


def analyze(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, column, rows, nulls, distinct): what a planner would ask of each column; distinct is approximate."""
    out = None
    for name, df in tables.items():
        for c in df.columns:
            flat = F.to_json(F.struct(F.col(c))) if "<" in df.schema[c].dataType.simpleString() else F.col(c).cast("string")
            one = df.agg(F.lit(name).alias("relation"), F.lit(c).alias("column"), F.count("*").alias("rows"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.approx_count_distinct(flat).alias("distinct"))
            out = one if out is None else out.unionByName(one)
    return out.withColumn("nulls", F.coalesce("nulls", F.lit(0)))
