"""Extraction as a Spark stage, and the first pass from extracted rows to the tables of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.extract import csharp, rust
from quarry.extract.rust import Found
from quarry.plans.runtime import settled

#: Languages by name; a new one is a function from text to what is found in it.
EXTRACTORS: dict[str, Callable[[str], Found]] = {"rust": rust.extract, "csharp": csharp.extract}

SPAN = "struct<line:int,column:int,end_line:int,end_column:int>"
SYMBOL = "array<struct<name:string,kind:string,visibility:string,parent_name:string,signature:string,line:int,column:int,end_line:int,end_column:int,is_test:boolean,attributes:array<struct<name:string,args:string,line:int>>>>"
REF = f"array<struct<name:string,kind:string,path:array<string>,line:int,column:int,owner:{SPAN},anchor:string>>"
IMPORT = "array<struct<module:string,name:string,alias:string,line:int,public:boolean>>"
EXTRACTED = f"path string, language string, mtime_ns long, size_bytes long, symbols {SYMBOL}, refs {REF}, imports {IMPORT}, error string"


def extract_files(files: DataFrame) -> DataFrame:
    """(path, language, mtime_ns, size_bytes, symbols, refs, imports, error) from (path, language, mtime_ns, size_bytes, text).

    A file that cannot be read has an error and nothing else; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = ("line", "column", "end_line", "end_column")
        for batch in batches:
            rows = []
            for language, text in zip(batch["language"], batch["text"], strict=True):
                try:
                    got, error = EXTRACTORS[language](text or ""), None
                except Exception as e:  # one file's fault is its own
                    got, error = Found(), f"{type(e).__name__}: {e}"
                refs = [r | {"anchor": r.get("anchor"), "owner": dict(zip(span, r["owner"], strict=True)) if r["owner"] else None} for r in got.refs]
                rows.append((got.symbols, refs, got.imports, error))
            yield batch.drop(columns="text").assign(**{n: [r[k] for r in rows] for k, n in enumerate(("symbols", "refs", "imports", "error"))})

    source = files.select("path", "language", "mtime_ns", "size_bytes", "text")
    return source.mapInPandas(run, EXTRACTED)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with id, from 1 in the order of a distinct key: places within ranges of the key, and the ranges' offsets."""
    ranges = settled(df.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ranges.withColumn("place", place).join(F.broadcast(offsets), "part").select(*df.columns, (F.col("offset") + F.col("place")).cast("long").alias("id"))


def _place(file_id: str, n: str) -> Column:
    return F.shiftleft(file_id, 32).bitwiseOR(F.col(n).cast("long"))


def first_pass(extracted: DataFrame, modules: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, symbols, refs, imports and attributes. Ids come from the order of paths and of places in a file, so every run gives the same:
    an id is its file's in the upper 32 bits and its place in the file, which an array's length bounds, in the lower.

    modules: (path, module_path).
    """
    from quarry.operators.resolve import bind_same_file, parent_links
    from quarry.schema import CONTAINERS

    rows = extracted.join(numbered(extracted.select("path").distinct(), "path"), "path")
    files = rows.select("id", "path", "language", "mtime_ns", "size_bytes", F.lit(None).cast("long").alias("content_hash"), (F.unix_micros(F.current_timestamp()) * 1000).alias("indexed_at"))
    flat = rows.select(F.col("id").alias("file_id"), "path", F.posexplode("symbols").alias("n", "s"))
    flat = flat.select("file_id", "path", _place("file_id", "n").alias("id"), "s.*")
    flat = flat.withColumn("qualified_name", F.concat_ws("::", "parent_name", "name"))
    parents = parent_links(flat)
    flat = flat.join(parents, "id", "left")
    flat = flat.join(modules, "path", "left") if modules is not None else flat.withColumn("module_path", F.lit(""))
    symbols = flat.select("id", "file_id", "name", F.coalesce("module_path", F.lit("")).alias("module_path"), "qualified_name", "kind", "line", "column", "end_line", "end_column", "signature", "visibility", "parent_symbol_id", "is_test")
    own = F.flatten(F.transform("symbols", lambda s, i: F.transform(s["attributes"], lambda a: F.struct(i.alias("s"), a["name"].alias("name"), a["args"].alias("args"), a["line"].alias("line")))))
    attributes = rows.select(F.col("id").alias("file_id"), F.posexplode(own).alias("n", "a")).select(_place("file_id", "n").alias("id"), _place("file_id", "a.s").alias("symbol_id"), "a.name", "a.args", "a.line")
    named = F.concat_ws("::", "r.path", "r.name")
    refs = rows.select(F.col("id").alias("file_id"), "language", F.posexplode("refs").alias("n", "r"))
    # a supertype is bound by its own name; its path only anchors the subtype
    full = F.when(F.col("r.anchor").isNotNull() | ((F.col("r.kind") == "inherit") & (F.col("language") == "rust")), F.col("r.name")).otherwise(named)
    refs = refs.select(_place("file_id", "n").alias("id"), "file_id", "r.kind", "r.line", "r.column", "r.owner", "r.anchor", full.alias("reference_name"))
    spans = symbols.groupBy("file_id", "line", "column", "end_line", "end_column").agg(F.max("id").alias("in_symbol_id"))
    refs = refs.select("*", *[F.col(f"owner.{c}").alias(f"o_{c}") for c in ("line", "column", "end_line", "end_column")])
    on = spans.select("file_id", *[F.col(c).alias(f"o_{c}") for c in ("line", "column", "end_line", "end_column")], "in_symbol_id")
    refs = refs.join(on, ["file_id", "o_line", "o_column", "o_end_line", "o_end_column"], "left")
    boxes = symbols.where(F.col("kind").isin(CONTAINERS)).groupBy("file_id", F.col("name").alias("anchor")).agg(F.count("*").alias("k"), F.min("id").alias("box")).where("k = 1").drop("k")
    refs = refs.join(boxes, ["file_id", "anchor"], "left").withColumn("in_symbol_id", F.coalesce("in_symbol_id", "box"))
    bound = bind_same_file(refs.drop("owner", "anchor", "box"), symbols)
    gone = F.lit(None).cast("int")
    refs = bound.select("id", "symbol_id", "file_id", F.when(F.col("kind") == "method", "call").otherwise(F.col("kind")).alias("kind"), "line", "column", gone.alias("end_line"), gone.alias("end_column"), "in_symbol_id", F.when(F.col("symbol_id").isNull(), F.col("reference_name")).alias("reference_name"), "strategy")
    uses = rows.select(F.col("id").alias("file_id"), F.posexplode("imports").alias("n", "i")).select("file_id", "n", F.coalesce("i.name", F.lit("*")).alias("symbol_name"), F.col("i.module").alias("source_module"), "i.alias")
    imports = uses.groupBy("file_id", "symbol_name", "source_module").agg(F.max_by(F.struct("alias"), "n").alias("a")).select("file_id", "symbol_name", "source_module", "a.alias")
    return {"files": files, "symbols": symbols, "refs": refs, "imports": imports, "attributes": attributes}
