"""Binding of references to symbols by ordered, labelled arms; ambiguity declines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import first_segment, is_qualified, last_segment
from quarry.operators.lookups import first_of
from quarry.schema import CONTAINERS, DATA_MEMBERS

ARMS = ["explicit_import", "glob_import", "import_union", "qualified_exact", "same_crate", "unique_workspace", "qualified_module_fallback"]


def gate_class(kind: Column) -> Column:
    """What a reference of a kind may bind to: macros, code (no data members), containers, or anything."""
    return F.when(kind == "macro", "macro").when(kind.isin("call", "construct", "macro_call"), "code").when(kind == "inherit", "container").otherwise("any")


def passes(gate: Column, symbol_kind: Column) -> Column:
    return F.when(gate == "macro", symbol_kind == "macro").when(gate == "code", ~symbol_kind.isin(DATA_MEMBERS)).when(gate == "container", symbol_kind.isin(CONTAINERS)).otherwise(True)


def distinct_names(refs: DataFrame) -> DataFrame:
    """(file_id, name, gate) of unresolved references; a name that is no macro has the gate of its first reference in the file."""
    rows = refs.where("symbol_id is null and reference_name is not null").select("file_id", F.col("reference_name").alias("name"), gate_class(F.col("kind")).alias("gate"), "line")
    macros = rows.where("gate = 'macro'").select("file_id", "name", "gate").distinct()
    others = rows.where("gate != 'macro'").groupBy("file_id", "name").agg(F.min_by("gate", F.struct("line", "gate")).alias("gate"))
    return macros.unionByName(others)


def parent_links(symbols: DataFrame) -> DataFrame:
    """(id, parent_symbol_id) from (id, file_id, parent_name): the only container of that name in the file, and not itself."""
    own = symbols.where(F.col("kind").isin(CONTAINERS)).groupBy("file_id", F.col("name").alias("parent_name")).agg(F.count("*").alias("n"), F.min("id").alias("parent_symbol_id")).where("n = 1").drop("n")
    out = symbols.select("id", "file_id", "parent_name").join(own, ["file_id", "parent_name"], "left")
    return out.select("id", F.when(F.col("parent_symbol_id") != F.col("id"), F.col("parent_symbol_id")).alias("parent_symbol_id"))


def bind_same_file(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (id, file_id, kind, reference_name) with symbol_id where the file itself declares the name; the last declaration wins.

    Macros bind to macros, method calls (kind method) to nothing, field accesses to data members first, supertypes to a
    container that is unique in the file; all else to what is no data member, by name and then by qualified name.
    """

    def last(rows: DataFrame, column: str, out: str) -> DataFrame:
        return rows.groupBy("file_id", F.col(column).alias("reference_name")).agg(F.max("id").alias(out))

    general = symbols.where(~F.col("kind").isin(DATA_MEMBERS))
    boxes = symbols.where(F.col("kind").isin(CONTAINERS)).groupBy("file_id", F.col("name").alias("reference_name")).agg(F.count("*").alias("n"), F.min("id").alias("box")).where("n = 1").drop("n")
    out = refs
    for dim in (last(symbols.where("kind = 'macro'"), "name", "macro"), last(symbols.where(F.col("kind").isin(DATA_MEMBERS)), "name", "member"), last(general, "name", "plain"), last(general, "qualified_name", "full"), boxes):
        out = out.join(dim, ["file_id", "reference_name"], "left")
    found = F.when(F.col("kind") == "macro", F.col("macro")).when(F.col("kind") == "method", None).when(F.col("kind") == "inherit", F.col("box"))
    found = found.when(F.col("kind") == "field_access", F.coalesce("member", "plain", "full")).otherwise(F.coalesce("plain", "full"))
    return out.withColumn("symbol_id", found).withColumn("strategy", F.when(found.isNotNull(), "same_file")).drop("macro", "member", "plain", "full", "box")


def _in_file(keys: DataFrame, symbols: DataFrame, qualified: Column) -> DataFrame:
    """keys (file_id, name, target_file, target, ..) with symbol_id: the least id in the target file whose qualified name, or else whose name, is the target."""
    s = symbols.select(F.col("file_id").alias("target_file"), F.col("name").alias("last"), "qualified_name", "id")
    out = keys.withColumns({"last": last_segment(F.col("target")), "whole": qualified}).join(s, ["target_file", "last"])
    out = out.where(F.when(F.col("whole"), F.col("qualified_name") == F.col("target")).otherwise(F.col("last") == F.col("target")))
    return out.groupBy(*keys.columns).agg(F.min("id").alias("symbol_id"))


def _written(imports: DataFrame) -> DataFrame:
    """imports with `written`, the module as it stands in the source, by which they are ordered; source_module may be resolved further."""
    return imports if "written" in imports.columns else imports.withColumn("written", F.col("source_module"))


def explicit_import(names: DataFrame, imports: DataFrame, module_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id): the first segment is an imported name or its alias; of several imports the last by module and name counts."""
    named = _written(imports).where("symbol_name != '*'").withColumn("key", F.coalesce("alias", "symbol_name"))
    named = first_of(named, ["file_id", "key"], [F.desc("written"), F.desc("symbol_name")])
    keys = names.select("file_id", "name").distinct().withColumn("key", first_segment(F.col("name")))
    keys = keys.join(named.select("file_id", "key", "symbol_name", "source_module"), ["file_id", "key"])
    keys = keys.withColumn("target", F.concat("symbol_name", F.substring("name", F.length("key") + 1, F.length("name"))))
    keys = keys.join(module_files.select(F.col("module").alias("source_module"), F.col("file_id").alias("target_file")), "source_module")
    found = _in_file(keys.select("file_id", "name", "target_file", "target"), symbols, is_qualified(F.col("name")))
    return found.groupBy("file_id", "name").agg(F.min("symbol_id").alias("symbol_id"))


def glob_import(names: DataFrame, imports: DataFrame, module_files: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id) in Rust files: the first glob import, by module, whose file has the name.

    Names that no symbol has are left out before they meet a file's glob imports.
    """
    rust = files.where("language = 'rust'").select(F.col("id").alias("file_id"))
    globs = _written(imports).where("symbol_name = '*'").join(rust, "file_id", "left_semi").join(module_files.select(F.col("module").alias("source_module"), F.col("file_id").alias("target_file")), "source_module")
    keys = names.select("file_id", "name").distinct().withColumn("last", last_segment(F.col("name")))
    keys = keys.join(symbols.select(F.col("name").alias("last")).distinct(), "last", "left_semi").drop("last")
    keys = keys.join(globs.select("file_id", "written", "target_file"), "file_id").withColumn("target", F.col("name"))
    found = _in_file(keys.select("file_id", "name", "written", "target_file", "target"), symbols, is_qualified(F.col("name")))
    return found.groupBy("file_id", "name").agg(F.min_by("symbol_id", F.struct("written", "symbol_id")).alias("symbol_id"))


def import_union(names: DataFrame, imports: DataFrame, namespaces: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id) in C# files, simple names only: what all used namespaces (namespace, file_id) together hold, if it is one symbol.

    `using static` brings in the members of a type: its namespace is what precedes the last dot.
    """
    cs = files.where("language = 'csharp'").select(F.col("id").alias("file_id"))
    uses = imports.where("symbol_name = '*'").join(cs, "file_id", "left_semi").select("file_id", F.col("source_module").alias("namespace"))
    simple = names.where(~is_qualified(F.col("name"))).select("file_id", "name").distinct()
    simple = simple.join(symbols.select("name").distinct(), "name", "left_semi")  # before a name meets all files of a namespace
    plain = uses.join(namespaces.select("namespace", F.col("file_id").alias("target_file")), "namespace").select("file_id", "target_file")
    types = symbols.where(F.col("kind").isin(CONTAINERS)).select(F.col("file_id").alias("target_file"), "name", F.col("id").alias("symbol_id"))
    a = simple.join(plain, "file_id").join(types, ["target_file", "name"]).select("file_id", "name", "symbol_id")
    static = uses.withColumn("type", F.element_at(F.split("namespace", r"\."), -1)).withColumn("namespace", F.regexp_replace("namespace", r"\.[^.]*$", ""))
    static = static.join(namespaces.select("namespace", F.col("file_id").alias("target_file")), "namespace").select("file_id", "target_file", "type")
    members = symbols.where(F.col("kind").isin("function", "method")).select(F.col("file_id").alias("target_file"), "qualified_name", F.col("id").alias("symbol_id"))
    b = simple.join(static, "file_id").withColumn("qualified_name", F.concat_ws("::", "type", "name")).join(members, ["target_file", "qualified_name"]).select("file_id", "name", "symbol_id")
    both = a.unionByName(b).distinct()
    return both.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")


def qualified_exact(names: DataFrame, symbols: DataFrame) -> DataFrame:
    by_name = symbols.groupBy(F.col("qualified_name").alias("name")).agg(F.min("id").alias("symbol_id"))
    return names.where(is_qualified(F.col("name"))).select("file_id", "name").distinct().join(by_name, "name").select("file_id", "name", "symbol_id")


def same_crate(names: DataFrame, symbols: DataFrame, file_crates: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id): simple names that are unique in the file's crate; a crate at the root of the workspace (empty path) declines."""
    crates = file_crates.where("crate_path != ''").select("file_id", "crate")
    own = symbols.join(crates, "file_id").groupBy("crate", "name").agg(F.count("*").alias("n"), F.min("id").alias("symbol_id")).where("n = 1").drop("n")
    simple = names.where(~is_qualified(F.col("name"))).select("file_id", "name").distinct()
    return simple.join(crates, "file_id").join(own, ["crate", "name"]).select("file_id", "name", "symbol_id")


def unique_workspace(names: DataFrame, symbols: DataFrame) -> DataFrame:
    own = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("symbol_id")).where("n = 1").drop("n")
    simple = names.where(~is_qualified(F.col("name"))).select("file_id", "name").distinct()
    return simple.join(own, "name").select("file_id", "name", "symbol_id")


def qualified_fallback(names: DataFrame, module_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id): a leading part that is a module with a file claims what follows it; the longest part whose file has that by its qualified name wins."""
    claims = name_splits(names).join(module_files.select("module", F.col("file_id").alias("target_file")), "module")
    return by_claims(claims.withColumn("place", F.lit(0)), symbols)


def name_splits(names: DataFrame) -> DataFrame:
    """(file_id, name, cut, module, target): all ways to part a qualified name in two."""
    parts = F.split("name", "::")
    splits = names.where(is_qualified(F.col("name"))).select("file_id", "name").distinct()
    splits = splits.select("file_id", "name", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("cut"))
    return splits.withColumns({"module": F.array_join(F.slice(parts, F.lit(1), F.col("cut")), "::"), "target": F.array_join(F.slice(parts, F.col("cut") + 1, F.size(parts)), "::")})


def by_claims(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id) from claims (file_id, name, cut, place, target_file, target): each cut has its first claimed file alone, and a cut whose file lacks the target gives way to a shorter one."""
    first = first_of(claims, ["file_id", "name", "cut"], [F.asc("place"), F.asc("target_file")])
    found = _in_file(first.select("file_id", "name", "cut", "target_file", "target"), symbols, F.lit(True))
    return found.groupBy("file_id", "name").agg(F.max_by("symbol_id", "cut").alias("symbol_id"))


def resolve(names: DataFrame, arms: dict[str, DataFrame], symbols: DataFrame) -> DataFrame:
    """(file_id, name, gate, symbol_id, strategy): the first arm whose pick passes the gate; an arm's pick is made before the gate."""
    rows = None
    for order, arm in enumerate(a for a in ARMS if a in arms):
        one = arms[arm].select("file_id", "name", "symbol_id", F.lit(order).alias("place"), F.lit(arm).alias("strategy"))
        rows = one if rows is None else rows.unionByName(one)
    kinds = symbols.select(F.col("id").alias("symbol_id"), F.col("kind").alias("symbol_kind"))
    out = names.join(rows, ["file_id", "name"]).join(kinds, "symbol_id").where(passes(F.col("gate"), F.col("symbol_kind")))
    out = out.groupBy("file_id", "name", "gate").agg(F.min_by(F.struct("symbol_id", "strategy"), "place").alias("b"))
    return out.select("file_id", "name", "gate", "b.symbol_id", "b.strategy")


def resolve_by_server(refs: DataFrame, definitions: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, symbol_id, strategy) of unresolved refs by a language server's answers (ref_path, ref_line, ref_column, def_path, def_line)."""
    from quarry.operators.lookups import symbol_at_line

    ids = files.select("path", F.col("id").alias("file"))
    d = definitions.join(ids.select(F.col("path").alias("ref_path"), F.col("file").alias("file_id")), "ref_path")
    d = d.join(ids.select(F.col("path").alias("def_path"), F.col("file").alias("def_file")), "def_path")
    at = symbol_at_line(symbols, d.select(F.col("def_file").alias("file_id"), F.col("def_line").alias("line")))
    d = d.join(at.select(F.col("file_id").alias("def_file"), F.col("line").alias("def_line"), "symbol_id"), ["def_file", "def_line"])
    d = d.select("file_id", F.col("ref_line").alias("line"), F.col("ref_column").alias("column"), F.col("symbol_id").alias("found"))
    return refs.where("symbol_id is null").join(d, ["file_id", "line", "column"]).groupBy("id").agg(F.min("found").alias("symbol_id")).withColumn("strategy", F.lit("lsp"))


def apply_resolutions(refs: DataFrame, found: DataFrame) -> DataFrame:
    """refs with what was found for their file, name and gate; the written name of a resolved reference is dropped."""
    f = found.select("file_id", F.col("name").alias("reference_name"), "gate", F.col("symbol_id").alias("new_id"), F.col("strategy").alias("new_strategy"))
    f = f.withColumn("is_macro", F.col("gate") == "macro").drop("gate")
    out = refs.withColumn("is_macro", gate_class(F.col("kind")) == "macro").join(f, ["file_id", "reference_name", "is_macro"], "left")
    new = F.col("symbol_id").isNull() & F.col("new_id").isNotNull()
    out = out.withColumns({"reference_name": F.when(~new, F.col("reference_name")), "strategy": F.when(new, F.col("new_strategy")).otherwise(F.col("strategy")), "symbol_id": F.coalesce("symbol_id", "new_id")})
    return out.select(*refs.columns)


def without_noise(refs: DataFrame) -> DataFrame:
    """refs without unresolved values and macro calls."""
    return refs.where("symbol_id is not null or kind not in ('value', 'macro_call')")
