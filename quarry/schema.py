"""Relations, closed vocabularies and views of a code index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 2

TABLES = {
    "files": "id long, path string, language string, mtime_ns long, size_bytes long, content_hash long, indexed_at long",
    "symbols": "id long, file_id long, name string, module_path string, qualified_name string, kind string, line int, column int, end_line int, end_column int, signature string, visibility string, parent_symbol_id long, is_test boolean",
    "refs": "id long, symbol_id long, file_id long, kind string, line int, column int, end_line int, end_column int, in_symbol_id long, reference_name string, strategy string",
    "file_deps": "from_file_id long, to_file_id long, ref_count int",
    "imports": "file_id long, symbol_name string, source_module string, alias string",
    "call_edges": "caller_symbol_id long, callee_symbol_id long, call_count int",
    "attributes": "id long, symbol_id long, name string, args string, line int",
    "packages": "id long, name string, path string, source string",
    "file_packages": "file_id long, package_id long",
    "package_deps": "source_pkg long, target_pkg long, dep_count int",
    "crates": "name string, path string, lib_path string, bin_paths array<struct<name:string,path:string>>",
}

# The closed vocabularies.
LANGUAGES = {"rs": "rust", "cs": "csharp"}
SYMBOL_KINDS = ["function", "method", "struct", "class", "enum", "trait", "interface", "const", "static", "module", "type_alias", "macro", "enum_variant", "struct_field", "property", "event", "delegate"]
DATA_MEMBERS = ["property", "event", "struct_field"]
CONTAINERS = ["struct", "class", "enum", "trait", "interface", "type_alias"]
VISIBILITIES = ["public", "crate", "module", "private"]
REFERENCE_KINDS = ["import", "call", "type", "inherit", "construct", "field_access", "macro", "reexport", "value", "macro_call"]
STRATEGIES = ["same_file", "explicit_import", "glob_import", "import_union", "qualified_exact", "same_crate", "unique_workspace", "qualified_module_fallback", "lsp"]
HIGH = ["explicit_import", "lsp"]
MEDIUM = ["same_file", "glob_import", "import_union", "qualified_exact", "same_crate"]
#: Reference kinds that are no calls.
NOT_CALLS = ["value", "field_access", "macro_call", "inherit"]
KIND_ALIASES = {"fn": "function", "mod": "module", "type": "type_alias", "variant": "enum_variant", "field": "struct_field"}


def band(strategy: Column) -> Column:
    """high, medium or speculative; null where there is no strategy."""
    return F.when(strategy.isNull(), None).when(strategy.isin(HIGH), "high").when(strategy.isin(MEDIUM), "medium").otherwise("speculative")


def refs_named(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with name: the written name of an unresolved reference, else that of its symbol."""
    names = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"))
    return refs.join(names, "symbol_id", "left").withColumn("name", F.coalesce("reference_name", "symbol_name")).drop("symbol_name")


def refs_banded(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    return refs_named(refs, symbols).withColumn("band", band(F.col("strategy")))


def coupling(packages: DataFrame, package_deps: DataFrame) -> DataFrame:
    """(id, name, path, afferent, efferent, instability): isolated packages stay, with an instability of 0."""
    ca = package_deps.groupBy(F.col("target_pkg").alias("id")).agg(F.count("*").alias("afferent"))
    ce = package_deps.groupBy(F.col("source_pkg").alias("id")).agg(F.count("*").alias("efferent"))
    out = packages.join(ca, "id", "left").join(ce, "id", "left").fillna(0, ["afferent", "efferent"])
    both = F.col("afferent") + F.col("efferent")
    return out.select("id", "name", "path", "afferent", "efferent", F.when(both == 0, 0.0).otherwise(F.col("efferent") / both).alias("instability"))
