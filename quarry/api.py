"""The index of a workspace and all queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions.text import name_column, normalise_path
from quarry.operators import analyses as N
from quarry.operators import edges as E
from quarry.operators import graph as G
from quarry.operators import lookups as L
from quarry.plans.build import build_tables
from quarry.plans.runtime import settled
from quarry.sources import catalog, lsp, scan
from quarry.streaming.ingest import extraction_stream, latest


class NotFound(LookupError):
    """No file or symbol of that name is in the index."""


class Index:
    """Every method gives a DataFrame, unless it says otherwise. Paths are relative to the root or below it."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, definitions: DataFrame | None = None):
        self.spark, self.root = spark, root.removeprefix("file://").rstrip("/")
        self.folder = folder or f"{self.root}/.quarry/index"
        self.definitions = definitions
        self._tables: dict[str, DataFrame] | None = None

    # ------------------------------------------------------------------ building

    def with_lsp(self, definitions: DataFrame) -> Index:
        """With a language server's answers as rows (ref_path, ref_line, ref_column, def_path, def_line)."""
        return Index(self.spark, self.root, self.folder, definitions)

    def ask_server(self, command: list[str], language: str = "rust", timeout: float = 60.0, servers: int = 1) -> DataFrame:
        """A language server's answers for all references of a language that are not bound, for with_lsp(). `servers` run side by side, each for files of its own."""
        refs = self.refs.where("symbol_id is null").join(self.files.where(F.col("language") == language).select(F.col("id").alias("file_id"), "path"), "file_id")
        return lsp.definitions(refs.select("path", "line", "column"), self.root, command, language, timeout, servers)

    def get_lsp_callers(self, qualified_name: str, command: list[str], timeout: float = 60.0) -> DataFrame:
        """Direct callers, with those that a language server finds in its references to the symbol."""
        row = self.symbols.join(self.files.select(F.col("id").alias("file_id"), "path", "language"), "file_id").where(F.col("id") == self._symbol_id(qualified_name)).first()
        text = self._text().where(F.col("path") == row["path"]).select(F.element_at(F.split("content", "\n"), F.lit(row["line"])).alias("line")).first()
        column = name_column(text["line"] if text else "", row["name"], row["column"])
        found = lsp.references(self.spark, self.root, command, row["language"], row["path"], row["line"], column, timeout)
        sites = found.join(self.files.select("path", F.col("id").alias("file_id")), "path").select("file_id", "line")
        return self.get_callers(qualified_name, sites=sites)

    def index(self, languages: list[str] | None = None) -> dict:
        """Build or replace the index, of some languages only if they are given; gives counts and the files that could not be read."""
        sources = scan.scan_sources(self.spark, self.root).where(F.col("language").isin(languages)) if languages else None
        return self._store(*build_tables(self.spark, self.root, sources, self.definitions))

    index_with_options = index

    def _store(self, tables: dict[str, DataFrame], errors: DataFrame) -> dict:
        catalog.save(tables, self.folder)
        self._tables = None
        return {"files": self.files.count(), "symbols": self.symbols.count(), "refs": self.refs.count(), "errors": [(r["path"], r["reason"]) for r in errors.collect()]}

    def rebuild(self, languages: list[str] | None = None) -> dict:
        self.remove_index_files()
        return self.index(languages)

    rebuild_with_options = rebuild

    def update(self) -> dict:
        """Take in what has changed since: only new and modified files are extracted again, deleted ones go with all that hangs on them.

        References are bound anew over all files, as a new symbol may be what an old reference means. The tables are
        replaced as a whole. Nothing is written if nothing has changed.
        """
        stale = settled(N.staleness(self.files, self._disk()), "stale")
        if stale.isEmpty():
            return {}
        sources = scan.scan_sources(self.spark, self.root).join(stale.where("status != 'deleted'").select("path"), "path", "left_semi")
        reused = self.tables["extracted"].join(stale.select("path"), "path", "left_anti")
        return self._store(*build_tables(self.spark, self.root, sources, self.definitions, reused))

    def index_stream(self, table: str, checkpoint: str, files_per_batch: int = 100) -> dict:
        """Extract what is new under the root in batches of files, into a table that grows, and build the index from the last rows of
        all files that are still there. A run that was cut off goes on from its checkpoint."""
        extraction_stream(self.spark, self.root, table, checkpoint, files_per_batch).awaitTermination()
        rows = latest(self.spark, table).join(self._disk().select("path"), "path", "left_semi")
        none = scan.scan_sources(self.spark, self.root).where(F.lit(False))
        return self._store(*build_tables(self.spark, self.root, none, self.definitions, rows))

    def delete_files(self, paths: list[str]) -> int:
        """Take files out of the index, with their symbols, references from and to these, and edges; gives how many there were."""
        return self._without(self.files.where(F.col("path").isin([self._path(p) for p in paths])))

    def purge_orphan_files(self) -> int:
        """Take out files that are no longer on disk; gives how many there were."""
        gone = N.staleness(self.files, self._disk()).where("status = 'deleted'").select("path")
        return self._without(self.files.join(gone, "path", "left_semi"))

    def _without(self, files: DataFrame) -> int:
        gone = settled(files.select(F.col("id").alias("file_id")), "gone")
        n = gone.count()
        if n:
            catalog.save(catalog.without_files(self.tables, gone), self.folder)
            self._tables = None
        return n

    def remove_index_files(self) -> None:
        catalog.remove(self.spark, self.folder)
        self._tables = None

    def db_path(self) -> str:
        return self.folder

    def vacuum(self) -> None:
        """Rewrite the tables in few sorted files and delete older generations."""
        catalog.compact(self.tables, self.folder)
        self._tables = None

    def analyze(self) -> DataFrame:
        """(relation, column, rows, nulls, distinct)."""
        return catalog.analyze({n: self.tables[n] for n in schema.TABLES})

    @property
    def tables(self) -> dict[str, DataFrame]:
        if self._tables is None:
            self._tables = catalog.load(self.spark, self.folder)
        return self._tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in schema.TABLES:
            return self.tables[name]
        raise AttributeError(name)

    # ------------------------------------------------------------------ names

    def _path(self, path: str) -> str:
        return normalise_path(path, self.root)

    def _file_id(self, path: str) -> int:
        row = self.files.where(F.col("path") == self._path(path)).select("id").first()
        if row is None:
            raise NotFound(path)
        return row["id"]

    def _symbol_id(self, qualified_name: str) -> int:
        row = L.symbol_by_name(self.symbols, qualified_name).select("id").first()
        if row is None:
            raise NotFound(qualified_name)
        return row["id"]

    # ------------------------------------------------------------------ lookups

    def get_file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == self._path(path))

    def get_file_id(self, path: str) -> int | None:
        row = self.get_file(path).select("id").first()
        return row and row["id"]

    def get_files_by_ids(self, ids: list[int]) -> DataFrame:
        return self.files.join(F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "id long").distinct()), "id", "left_semi").orderBy("path")

    def get_file_by_id(self, file_id: int) -> DataFrame:
        return self.files.where(F.col("id") == file_id)

    def get_files_by_language(self, language: str) -> DataFrame:
        return self.files.where(F.col("language") == language).orderBy("path")

    def list_all_files(self) -> DataFrame:
        return self.files.orderBy("path")

    def search_symbols(self, query: str, limit: int = 100, kind: str | None = None) -> DataFrame:
        return L.search_symbols(self.symbols, query, limit, kind)

    def list_symbols(self, path: str) -> DataFrame:
        return L.symbols_in_file(self.symbols, self._file_id(path))

    def get_symbol(self, qualified_name: str) -> DataFrame:
        return L.symbol_by_name(self.symbols, qualified_name)

    def get_symbol_by_id(self, symbol_id: int) -> DataFrame:
        return self.symbols.where(F.col("id") == symbol_id)

    def get_references(self, qualified_name: str) -> DataFrame:
        return L.references_to(self.refs, self._symbol_id(qualified_name))

    def list_references_in_file(self, path: str) -> DataFrame:
        return L.references_in_file(self.refs, self._file_id(path))

    def list_imports_in_file(self, path: str) -> DataFrame:
        return L.imports_in_file(self.imports, self._file_id(path))

    def get_test_symbols(self) -> DataFrame:
        return L.test_symbols(self.symbols)

    def get_stats(self) -> DataFrame:
        return L.stats(self.files, self.symbols, self.refs, self.file_deps)

    def refs_named(self) -> DataFrame:
        return schema.refs_named(self.refs, self.symbols)

    def refs_banded(self) -> DataFrame:
        return schema.refs_banded(self.refs, self.symbols)

    # ------------------------------------------------------------------ crates

    def _owned(self) -> DataFrame:
        return scan.file_crates(self.files.select("id", "path"), self.crates)

    def get_crate_for_file(self, path: str) -> DataFrame:
        return self._owned().where(F.col("path") == self._path(path)).select("crate", "crate_path", "lib_path", "bin_paths")

    def get_crate_root_for_file(self, path: str) -> DataFrame:
        return self._owned().where(F.col("path") == self._path(path)).select("crate_path")

    # ------------------------------------------------------------------ graphs

    def get_dependencies(self, path: str) -> DataFrame:
        return L.file_neighbours(self.file_deps, self.files, self._file_id(path))

    def get_dependents(self, path: str) -> DataFrame:
        return L.file_neighbours(self.file_deps, self.files, self._file_id(path), dependents=True)

    def _one(self, node: int) -> DataFrame:
        return self.spark.createDataFrame([(node,)], "node long")

    def get_impact(self, path: str, max_depth: int = G.DEFAULT_DEPTH) -> DataFrame:
        """(path, depth) of all files that depend on one."""
        found = G.reach(self.file_deps, "to_file_id", "from_file_id", self._one(self._file_id(path)), max_depth)
        return found.join(self.files.select(F.col("id").alias("node"), "path"), "node").select("path", "depth").orderBy("depth", "path")

    def _edges(self, exclude_speculative: bool) -> DataFrame:
        return E.supported_edges(self.call_edges, self.refs_banded()) if exclude_speculative else self.call_edges

    def get_callers(self, qualified_name: str, exclude_speculative: bool = False, sites: DataFrame | None = None) -> DataFrame:
        """Direct callers; sites (file_id, line) of a language server add theirs, and do not go with exclude_speculative."""
        if sites is not None and exclude_speculative:
            raise ValueError("sites cannot be told speculative or not")
        found = L.direct_callers(self._edges(exclude_speculative), self.symbols, self._symbol_id(qualified_name))
        return found if sites is None else L.refined_callers(found, sites, self.symbols)

    def get_symbol_dependencies(self, qualified_name: str) -> DataFrame:
        return L.direct_callees(self.call_edges, self.symbols, self._symbol_id(qualified_name))

    def get_symbol_impact(self, qualified_name: str, max_depth: int = G.DEFAULT_DEPTH, exclude_speculative: bool = False) -> DataFrame:
        """Symbols that call one, however far, with their least depth."""
        found = G.reach(self._edges(exclude_speculative), "callee_symbol_id", "caller_symbol_id", self._one(self._symbol_id(qualified_name)), max_depth)
        return self.symbols.join(found.withColumnRenamed("node", "id"), "id").orderBy("depth", "qualified_name")

    def get_reachable(self, qualified_name: str, direction: str = "forward", max_depth: int = G.DEFAULT_DEPTH) -> DataFrame:
        """(node, depth, path, rank): one shortest path of symbol ids to each symbol."""
        ends = ("caller_symbol_id", "callee_symbol_id") if direction == "forward" else ("callee_symbol_id", "caller_symbol_id")
        names = self.symbols.select(F.col("id").alias("node"), F.col("qualified_name").alias("name"))
        return G.reach_paths(self.call_edges, *ends, self._symbol_id(qualified_name), names, max_depth)

    def get_forward_reachable(self, qualified_name: str, max_depth: int = G.DEFAULT_DEPTH) -> DataFrame:
        return self.get_reachable(qualified_name, "forward", max_depth)

    def get_backward_reachable(self, qualified_name: str, max_depth: int = G.DEFAULT_DEPTH) -> DataFrame:
        return self.get_reachable(qualified_name, "backward", max_depth)

    def get_dependency_chain(self, source: str, target: str) -> DataFrame:
        names = self.files.select(F.col("id").alias("node"), F.col("path").alias("name"))
        chain = G.dependency_chain(self.file_deps, "from_file_id", "to_file_id", self._file_id(source), self._file_id(target), names)
        return chain.join(names, "node").select("position", F.col("name").alias("path")).orderBy("position")

    def detect_cycles(self) -> DataFrame:
        return G.ordered_cycles(G.detect_cycles(self.file_deps, self.files)).orderBy("cycle")

    def get_type_hierarchy(self, name: str, direction: str = "up") -> DataFrame:
        return G.type_hierarchy(name, direction, self.refs, self.symbols).orderBy("depth", "name")

    # ------------------------------------------------------------------ analyses

    def _disk(self) -> DataFrame:
        return scan.scan_sources(self.spark, self.root).select("path", "mtime_ns", "size_bytes")

    def get_stale_files(self) -> DataFrame:
        return N.staleness(self.files, self._disk()).orderBy("path")

    def needs_update(self) -> bool:
        return not N.staleness(self.files, self._disk()).isEmpty()

    def get_affected_tests(self, paths: list[str]) -> DataFrame:
        changed = self.files.where(F.col("path").isin([self._path(p) for p in paths])).select(F.col("id").alias("file_id"))
        return N.affected_tests(changed, self.file_deps, self.symbols).orderBy("file_id", "line")

    def get_affected_tests_with_standing(self, paths: list[str]) -> tuple[DataFrame, DataFrame]:
        """(tests, reasons why they may not be all); no paths are always confirmed."""
        rows = [(i, self._path(p)) for i, p in enumerate(paths)]
        inputs = self.spark.createDataFrame(rows, "ordinal long, path string")
        return self.get_affected_tests(paths), N.query_standing(inputs, self.files, self._disk()).orderBy("ordinal")

    def get_panic_points(self, include_tests: bool = False, path: str | None = None) -> DataFrame:
        return N.panic_points(self.refs_named(), self.symbols, self.files, include_tests, path and self._path(path)).orderBy("path", "line")

    def count_panic_points(self) -> DataFrame:
        return N.panic_counts(N.panic_points(self.refs_named(), self.symbols, self.files, include_tests=True))

    def get_deprecated_symbols(self) -> DataFrame:
        return N.deprecated_symbols(self.attributes, self.symbols)

    def get_deprecated_callers(self) -> DataFrame:
        return N.deprecated_callers(self.get_deprecated_symbols(), self.refs, self.symbols, self.files)

    def get_visibility_candidates(self, workspace_closed: bool = False) -> DataFrame:
        return N.visibility_candidates(self.symbols, self.refs, self.imports, self.files, self.file_packages, self.packages, workspace_closed).orderBy("qualified_name", "id")

    def get_untested_code(self) -> tuple[DataFrame, bool]:
        """(functions and methods that no test reaches, whether there are tests at all)."""
        found, told = N.untested_code(self.refs, self.symbols)
        return found.orderBy("file_id", "line"), told

    def _text(self) -> DataFrame:
        return scan.split_valid(scan.scan_sources(self.spark, self.root))[0].select("path", "language", F.col("text").alias("content"))

    def dead_code_summary(self) -> dict[str, int]:
        """How many candidates each tier has, whatever limit find_dead_code() is given."""
        found = N.tiered_dead_code(N.dead_code(self.symbols, self.refs, self.files), self._text())
        return {"definite": 0, "maybe": 0} | {r["tier"]: r["count"] for r in found.groupBy("tier").count().collect()}

    def find_dead_code(self, limit: int | None = None) -> DataFrame:
        found = N.tiered_dead_code(N.dead_code(self.symbols, self.refs, self.files), self._text()).orderBy("path", "line", "name")
        return found if limit is None else found.limit(limit)

    def find_unused_imports(self, all_tiers: bool = True) -> DataFrame:
        """(path, line, symbol_name, source_module, confidence) of Rust imports that their file does not use."""
        from quarry.operators.unused import unused_imports

        found = unused_imports(self._text().where("language = 'rust'"), self.symbols)
        return (found if all_tiers else found.where("confidence = 'definite'")).orderBy("path", "line", "symbol_name")

    # ------------------------------------------------------------------ packages

    def get_packages(self) -> DataFrame:
        return self.packages.orderBy("name")

    def get_coupling_metrics(self, sort: str = "instability") -> DataFrame:
        return L.coupling_table(schema.coupling(self.packages, self.package_deps), sort)

    def get_package_coupling(self, name: str) -> DataFrame:
        row = self.packages.where(F.col("name") == name).select("id").first()
        if row is None:
            near = [r["name"] for r in self.packages.orderBy(F.levenshtein("name", F.lit(name)), "name").limit(5).collect()]
            raise NotFound(f"{name}; near it: {', '.join(near)}")
        return L.package_neighbours(self.package_deps, self.packages, row["id"])
