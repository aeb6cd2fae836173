"""From a workspace's files to the tables of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.extract.stage import extract_files, first_pass
from quarry.functions.text import first_segment
from quarry.operators import edges as E
from quarry.operators import resolve as R
from quarry.operators.lookups import first_of
from quarry.plans.runtime import settled
from quarry.schema import refs_named
from quarry.sources import scan
from quarry.sources.catalog import STORED


def absolute_imports(imports: DataFrame, modules: DataFrame, owned: DataFrame) -> DataFrame:
    """imports whose module starts at the crate: self and super are written out, and crate names their scope."""
    own = modules.select("file_id", "module_path").join(owned.select("file_id", "crate"), "file_id")
    out = imports.join(own, "file_id", "left")
    module = F.col("source_module")
    up = F.regexp_replace("module_path", "(^|::)[^:]+$", "")
    path = F.when(module.startswith("self"), F.concat("module_path", F.substring(module, 5, F.length(module))))
    path = path.when(module.startswith("super"), F.concat(up, F.substring(module, 6, F.length(module)))).otherwise(module)
    return out.withColumn("full_module", F.coalesce(path, module)).withColumn("scope", F.when(F.col("full_module").rlike("^crate(::|$)"), F.col("crate")).otherwise("*"))


def file_level(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, file_id) for imports: a module's name with its scope, as one key."""
    return modules.select(F.concat_ws("|", "scope", "module").alias("module"), "file_id")


def build_tables(spark: SparkSession, root: str, sources: DataFrame | None = None, definitions: DataFrame | None = None, reused: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, errors (path, reason)) of the workspace under a folder.

    sources: rows of scan_sources(), if not all of the folder. definitions: a language server's answers, for a third pass.
    reused: what extract_files() has found before in files that have not changed and are not among the sources.
    """
    good, bad = scan.split_valid(sources if sources is not None else scan.scan_sources(spark, root))
    fresh = extract_files(good)
    extracted = settled(fresh if reused is None else reused.select(*fresh.columns).unionByName(fresh), "extracted")
    errors = bad.unionByName(extracted.where("error is not null").select("path", F.col("error").alias("reason")))
    crates = settled(scan.discover_crates(spark, root), "crates")
    plain = extracted.select(F.xxhash64("path").alias("id"), "path")
    owned_by_path = scan.file_crates(plain, crates)
    by_path = scan.module_paths(owned_by_path).join(owned_by_path.select("file_id", "path"), "file_id").select("path", "module_path")
    first = {n: settled(df, n) for n, df in first_pass(extracted, by_path).items()}
    files, symbols, imports = first["files"], first["symbols"], first["imports"]
    owned = settled(scan.file_crates(files.select("id", "path"), crates), "owned")
    homes = scan.homes(files.select("id", "path"), owned)
    modules = settled(scan.module_paths(owned), "modules")
    reach = settled(scan.module_files(owned, modules), "module-files")
    known = file_level(imports, reach)
    full = absolute_imports(imports, modules, owned).withColumn("written", F.col("source_module")).withColumn("source_module", F.concat_ws("|", "scope", "full_module")).select("file_id", "symbol_name", "source_module", "alias", "written")
    csharp = files.where("language = 'csharp'").select(F.col("id").alias("file_id"))
    full = full.join(csharp, "file_id", "left_anti").unionByName(imports.join(csharp, "file_id", "left_semi").withColumn("written", F.col("source_module")))
    crate_of = owned.select("file_id", "crate", "crate_path")
    refs = settled(_second_pass(first["refs"], symbols, settled(full, "full-imports"), files, crate_of, known, reach, owned), "refs")
    if definitions is not None:
        found = R.resolve_by_server(refs, definitions, symbols, files).withColumnsRenamed({"symbol_id": "new", "strategy": "how"})
        refs = refs.join(found, "id", "left").withColumns({"reference_name": F.when(F.col("new").isNull(), F.col("reference_name")), "symbol_id": F.coalesce("symbol_id", "new"), "strategy": F.coalesce("strategy", "how")}).drop("new", "how")
        refs = settled(refs, "refs")
    refs = settled(R.without_noise(refs), "refs")
    calls = settled(E.call_edges(refs), "calls")
    pairs = settled(E.file_pairs(calls, symbols), "pairs")
    spaces = E.csharp_corroboration(pairs, imports, symbols, files)
    by_calls = E.corroborated(pairs, homes, E.imported_crates(imports, crates), spaces)
    words = refs_named(refs, symbols)
    said = words.select("file_id", F.col("name")).unionByName(words.select("file_id", first_segment(F.col("name")).alias("name"))).distinct()
    deps = settled(E.merged(by_calls, E.import_dependencies(full, said, known)), "deps")
    packages = crates.select(F.xxhash64("name").alias("id"), "name", "path", F.lit("manifest").alias("source"))
    file_packages = owned.select("file_id", F.xxhash64("crate").alias("package_id"))
    out = first | {"extracted": extracted, "refs": refs, "call_edges": calls, "file_deps": deps, "packages": packages, "file_packages": file_packages, "package_deps": E.package_deps(deps, file_packages), "crates": crates}
    return {n: out[n].select(*spark.createDataFrame([], kind).columns) for n, kind in STORED.items()}, errors


def _second_pass(refs, symbols, imports, files, crate_of, known, reach, owned) -> DataFrame:
    names = settled(R.distinct_names(refs), "names")
    cs = files.where("language = 'csharp'").select(F.col("id").alias("file_id"))
    spaces = symbols.where("kind = 'module'").join(cs, "file_id", "left_semi").select(F.col("name").alias("namespace"), "file_id").distinct()
    # a qualified name may start at the crate or name another one: a prefix is tried below the crate first, then as it is written
    rust = files.where("language = 'rust'").select(F.col("id").alias("file_id"))
    splits = R.name_splits(names.join(rust, "file_id", "left_semi")).join(owned.select("file_id", "crate"), "file_id", "left")
    module = F.col("module")
    own = F.when(~module.rlike("^(crate|self|super)(::|$)"), F.concat_ws("|", "crate", F.concat(F.lit("crate::"), module)))
    written = F.when(module.rlike("^crate(::|$)"), F.concat_ws("|", "crate", "module")).otherwise(F.concat(F.lit("*|"), module))
    tried = splits.select("file_id", "name", "cut", "target", F.posexplode(F.array(own, written)).alias("place", "module")).where("module is not null")
    fallback = R.by_claims(tried.join(known.withColumnRenamed("file_id", "target_file"), "module"), symbols)
    arms = {
        "explicit_import": R.explicit_import(names, imports, known, symbols),
        "glob_import": R.glob_import(names, imports, known, symbols, files),
        "import_union": R.import_union(names, imports, spaces, symbols, files),
        "qualified_exact": R.qualified_exact(names, symbols),
        "same_crate": R.same_crate(names, symbols, crate_of),
        "unique_workspace": R.unique_workspace(names, symbols),
        "qualified_module_fallback": fallback,
    }
    return R.apply_resolutions(refs, R.resolve(names, arms, symbols))
