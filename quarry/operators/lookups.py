"""Point lookups, searches and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.schema import KIND_ALIASES, LANGUAGES, SYMBOL_KINDS


def search_symbols(symbols: DataFrame, query: str, limit: int = 100, kind: str | None = None) -> DataFrame:
    """Symbols whose name or qualified name holds the query, letters of either case alike; % and _ are wildcards.

    An exact name comes first, then short qualified names, then small ids. A kind is applied after the limit.
    """
    if not query:
        return symbols.limit(0)
    like = f"%{query}%"
    out = symbols.where(F.col("name").ilike(like) | F.col("qualified_name").ilike(like))
    out = out.orderBy(F.when(F.col("name") == query, 0).otherwise(1), F.length("qualified_name"), "id").limit(limit)
    return out.where(F.col("kind") == KIND_ALIASES.get(kind, kind)) if kind else out


def symbols_in_file(symbols: DataFrame, file_id: int) -> DataFrame:
    return symbols.where(F.col("file_id") == file_id).orderBy("line", "id")


def symbol_by_name(symbols: DataFrame, qualified_name: str) -> DataFrame:
    """The symbol of least id with a qualified name."""
    return symbols.where(F.col("qualified_name") == qualified_name).orderBy("id").limit(1)


def symbols_by_kind(symbols: DataFrame, kind: str, limit: int) -> DataFrame:
    return symbols.where(F.col("kind") == kind).orderBy("id").limit(limit)


def test_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_test").orderBy("file_id", "line")


def references_to(refs: DataFrame, symbol_id: int) -> DataFrame:
    return refs.where(F.col("symbol_id") == symbol_id).orderBy("file_id", "line")


def references_in_file(refs: DataFrame, file_id: int) -> DataFrame:
    return refs.where(F.col("file_id") == file_id).orderBy("line", "column")


def imports_in_file(imports: DataFrame, file_id: int) -> DataFrame:
    return imports.where(F.col("file_id") == file_id).orderBy("source_module", "symbol_name")


def symbol_at_line(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """(file_id, line, symbol_id): of the symbols that begin on a line, that of the lowest column."""
    found = places.select("file_id", "line").distinct().join(symbols, ["file_id", "line"])
    return found.groupBy("file_id", "line").agg(F.min_by("id", F.struct("column", "id")).alias("symbol_id"))


def innermost_symbol(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """(file_id, line, symbol_id): the innermost symbol around each place; a join on the file with the range as a residue."""
    s = symbols.select("file_id", "id", F.col("line").alias("start"), F.coalesce("end_line", "line").alias("stop"), "column")
    inside = places.select("file_id", "line").distinct().join(s, "file_id").where("line between start and stop")
    order = F.struct(-F.col("start"), F.col("stop"), -F.col("column"), F.col("id"))
    return inside.groupBy("file_id", "line").agg(F.min_by("id", order).alias("symbol_id"))


def direct_callers(edges: DataFrame, symbols: DataFrame, symbol_id: int) -> DataFrame:
    e = edges.where(F.col("callee_symbol_id") == symbol_id).select(F.col("caller_symbol_id").alias("id"), "call_count")
    return symbols.join(e, "id").orderBy("qualified_name", "id")


def direct_callees(edges: DataFrame, symbols: DataFrame, symbol_id: int) -> DataFrame:
    e = edges.where(F.col("caller_symbol_id") == symbol_id).select(F.col("callee_symbol_id").alias("id"), "call_count")
    return symbols.join(e, "id").orderBy("qualified_name", "id")


def refined_callers(indexed: DataFrame, sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Indexed callers and the innermost symbols of sites (file_id, line) that a language server found, each once."""
    extra = innermost_symbol(symbols, sites).select(F.col("symbol_id").alias("id")).distinct()
    extra = symbols.join(extra, "id", "left_semi").join(indexed.select("id"), "id", "left_anti").withColumn("call_count", F.lit(None).cast("int"))
    return indexed.withColumn("source", F.lit("indexed")).unionByName(extra.withColumn("source", F.lit("lsp")))


def file_neighbours(deps: DataFrame, files: DataFrame, file_id: int, dependents: bool = False) -> DataFrame:
    """(file_id, path, ref_count) of the files that a file depends on, or that depend on it; a null path is a dangling row."""
    own, other = ("to_file_id", "from_file_id") if dependents else ("from_file_id", "to_file_id")
    e = deps.where(F.col(own) == file_id).select(F.col(other).alias("file_id"), "ref_count")
    return e.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").orderBy("path")


def counts_by(table: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(value, count) of a closed vocabulary; all other values together are `skipped`."""
    value = F.when(F.col(column).isin(known), F.col(column)).otherwise("skipped")
    return table.groupBy(value.alias("value")).agg(F.count("*").alias("count"))


def stats(files: DataFrame, symbols: DataFrame, refs: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: counts by language and by kind as maps, and of files, symbols, references and dependencies."""

    def as_map(df, column, known):
        return counts_by(df, column, known).agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias(f"by_{column}"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))

    f = as_map(files, "language", list(LANGUAGES.values())).withColumnRenamed("n", "files")
    s = as_map(symbols, "kind", SYMBOL_KINDS).withColumnRenamed("n", "symbols")
    return f.crossJoin(s).crossJoin(refs.agg(F.count("*").alias("refs"))).crossJoin(deps.agg(F.count("*").alias("file_deps")))  # one row each


def coupling_table(coupling: DataFrame, sort: str = "instability") -> DataFrame:
    """Coupling metrics, the largest first, ties by name; or by name."""
    order = [F.asc("name")] if sort == "name" else [F.desc(sort), F.asc("name")]
    return coupling.orderBy(*order)


def package_neighbours(deps: DataFrame, packages: DataFrame, package_id: int) -> DataFrame:
    """(direction, name, dep_count): packages on either side of one, the most dependencies first, then by name."""
    into = deps.where(F.col("target_pkg") == package_id).select(F.lit("in").alias("direction"), F.col("source_pkg").alias("id"), "dep_count")
    out = deps.where(F.col("source_pkg") == package_id).select(F.lit("out").alias("direction"), F.col("target_pkg").alias("id"), "dep_count")
    return into.unionByName(out).join(packages.select("id", "name"), "id").select("direction", "name", "dep_count").orderBy("direction", F.desc("dep_count"), "name")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")
