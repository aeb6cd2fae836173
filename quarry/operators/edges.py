"""Edge tables derived from references: calls, file dependencies, package dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import first_segment
from quarry.schema import NOT_CALLS


def call_edges(refs: DataFrame) -> DataFrame:
    """Resolved references of call kinds, counted by (caller, callee)."""
    calls = refs.where(F.col("symbol_id").isNotNull() & F.col("in_symbol_id").isNotNull() & ~F.col("kind").isin(NOT_CALLS))
    out = calls.groupBy(F.col("in_symbol_id").alias("caller_symbol_id"), F.col("symbol_id").alias("callee_symbol_id"))
    return out.agg(F.count("*").cast("int").alias("call_count"))


def supported_edges(edges: DataFrame, banded: DataFrame) -> DataFrame:
    """Edges of which some reference between the two symbols, of any kind, is not speculative."""
    firm = banded.where(F.col("band") != "speculative").select(F.col("in_symbol_id").alias("caller_symbol_id"), F.col("symbol_id").alias("callee_symbol_id"))
    return edges.join(firm, ["caller_symbol_id", "callee_symbol_id"], "left_semi")


def file_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call counts summed by pairs of different files."""
    a = symbols.select(F.col("id").alias("caller_symbol_id"), F.col("file_id").alias("from_file_id"))
    b = symbols.select(F.col("id").alias("callee_symbol_id"), F.col("file_id").alias("to_file_id"))
    out = edges.join(a, "caller_symbol_id").join(b, "callee_symbol_id").where("from_file_id != to_file_id")
    return out.groupBy("from_file_id", "to_file_id").agg(F.sum("call_count").cast("int").alias("ref_count"))


def imported_crates(imports: DataFrame, crates: DataFrame) -> DataFrame:
    """(file_id, crate): workspace crates that a file imports; _ in a module may stand for - in a crate's name."""
    named = imports.select("file_id", first_segment(F.col("source_module")).alias("segment")).distinct()
    known = crates.select("name", F.replace(F.col("name"), F.lit("-"), F.lit("_")).alias("segment"))
    return named.join(known, "segment").select("file_id", F.col("name").alias("crate")).distinct()


def csharp_corroboration(pairs: DataFrame, imports: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file_id, to_file_id): pairs of C# files of which the first uses a namespace that the second declares."""
    cs = files.where("language = 'csharp'").select(F.col("id").alias("file_id"))
    uses = imports.join(cs, "file_id", "left_semi").select(F.col("file_id").alias("from_file_id"), F.col("source_module").alias("namespace")).distinct()
    spaces = symbols.where("kind = 'module'").join(cs, "file_id", "left_semi").select(F.col("file_id").alias("to_file_id"), F.col("name").alias("namespace")).distinct()
    named = pairs.select("from_file_id", "to_file_id").distinct().join(uses, "from_file_id")
    return named.join(spaces, ["to_file_id", "namespace"], "left_semi").select("from_file_id", "to_file_id").distinct()


def corroborated(pairs: DataFrame, file_crates: DataFrame, crate_imports: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """File pairs that are in one crate, or whose caller imports the callee's crate or namespace, or whose crate is unknown.

    file_crates: (file_id, crate), at most one row for a file; crate_imports: (file_id, crate).
    """
    a = file_crates.select(F.col("file_id").alias("from_file_id"), F.col("crate").alias("from_crate"))
    b = file_crates.select(F.col("file_id").alias("to_file_id"), F.col("crate").alias("to_crate"))
    seen = crate_imports.select(F.col("file_id").alias("from_file_id"), F.col("crate").alias("to_crate"), F.lit(True).alias("imported")).distinct()
    out = pairs.join(a, "from_file_id", "left").join(b, "to_file_id", "left").join(seen, ["from_file_id", "to_crate"], "left")
    keep = F.col("from_crate").isNull() | F.col("to_crate").isNull() | (F.col("from_crate") == F.col("to_crate")) | F.coalesce("imported", F.lit(False))
    if namespaces is not None:
        out = out.join(namespaces.withColumn("named", F.lit(True)), ["from_file_id", "to_file_id"], "left")
        keep = keep | F.coalesce("named", F.lit(False))
    return out.where(keep).select("from_file_id", "to_file_id", "ref_count")


def import_dependencies(imports: DataFrame, referenced: DataFrame, module_files: DataFrame) -> DataFrame:
    """One dependency for each pair of files of which the first imports, and uses, a name of the second; globs do not count.

    referenced: (file_id, name); module_files: (module, file_id).
    """
    used = imports.where("symbol_name != '*'").withColumn("name", F.coalesce("alias", "symbol_name"))
    used = used.join(referenced.select("file_id", "name"), ["file_id", "name"], "left_semi")
    to = module_files.select(F.col("module").alias("source_module"), F.col("file_id").alias("to_file_id"))
    out = used.join(to, "source_module").select(F.col("file_id").alias("from_file_id"), "to_file_id").where("from_file_id != to_file_id").distinct()
    return out.withColumn("ref_count", F.lit(1))


def unresolved_dependencies(imports: DataFrame, module_files: DataFrame) -> DataFrame:
    """(file_id, source_module): imports of modules that no file of the index has, such as those of other libraries."""
    return imports.join(module_files.select(F.col("module").alias("source_module")), "source_module", "left_anti").select("file_id", "source_module").distinct()


def merged(*deps: DataFrame) -> DataFrame:
    """Dependencies of several sources; counts add up."""
    out = deps[0]
    for more in deps[1:]:
        out = out.unionByName(more)
    return out.groupBy("from_file_id", "to_file_id").agg(F.sum("ref_count").cast("int").alias("ref_count"))


def package_deps(file_deps: DataFrame, file_packages: DataFrame) -> DataFrame:
    """File dependencies across packages, counted by pairs of packages."""
    a = file_packages.select(F.col("file_id").alias("from_file_id"), F.col("package_id").alias("source_pkg"))
    b = file_packages.select(F.col("file_id").alias("to_file_id"), F.col("package_id").alias("target_pkg"))
    out = file_deps.join(a, "from_file_id").join(b, "to_file_id").where("source_pkg != target_pkg")
    return out.groupBy("source_pkg", "target_pkg").agg(F.count("*").cast("int").alias("dep_count"))
