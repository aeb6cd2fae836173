"""Every operator as a query over the projected index, with the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions.text import is_qualified
from quarry.operators import analyses as N
from quarry.operators import edges as E
from quarry.operators import graph as G
from quarry.operators import lookups as L
from quarry.operators import resolve as R
from quarry.plans import code
from quarry.plans.projection import CTES, Projected, duck
from quarry.plans.runtime import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROOT, LEAF = 315, 30
CHAIN = (60, 2)


def query(sql: str | None = None, recursive: str = ""):
    """Register a function of the projection under its name; sql: the same rows for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Projected(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck(sql, recursive)
        return f

    return add


def _edges(p: Projected) -> DataFrame:
    return E.call_edges(p.refs)


def _deps(p: Projected) -> DataFrame:
    return E.file_pairs(_edges(p), p.symbols)


def _package_deps(p: Projected) -> DataFrame:
    return E.package_deps(_deps(p), p.file_packages)


BAND = "CASE WHEN strategy IS NULL THEN NULL WHEN strategy IN ('explicit_import', 'lsp') THEN 'high' WHEN strategy IN ('same_file', 'glob_import', 'import_union', 'qualified_exact', 'same_crate') THEN 'medium' ELSE 'speculative' END"
FIRM = f"(SELECT DISTINCT in_symbol_id AS x, symbol_id AS y FROM refs WHERE {BAND} <> 'speculative')"


@query(" SELECT * FROM call_edges")
def call_edges(p):
    return _edges(p)


@query(f" SELECT s.id, s.qualified_name, e.call_count FROM call_edges e JOIN symbols s ON s.id = e.caller_symbol_id WHERE e.callee_symbol_id = {ROOT}")
def callers_direct(p):
    return L.direct_callers(_edges(p), p.symbols, ROOT).select("id", "qualified_name", "call_count")


@query(f" SELECT s.id, s.qualified_name, e.call_count FROM call_edges e JOIN symbols s ON s.id = e.caller_symbol_id JOIN {FIRM} f ON f.x = e.caller_symbol_id AND f.y = e.callee_symbol_id WHERE e.callee_symbol_id = {ROOT}")
def callers_excl_speculative(p):
    e = E.supported_edges(_edges(p), schema.refs_banded(p.refs, p.symbols))
    return L.direct_callers(e, p.symbols, ROOT).select("id", "qualified_name", "call_count")


@query(f" SELECT s.id, s.qualified_name, s.is_test, e.call_count FROM call_edges e JOIN symbols s ON s.id = e.callee_symbol_id WHERE e.caller_symbol_id = {ROOT}")
def callees(p):
    return L.direct_callees(_edges(p), p.symbols, ROOT).select("id", "qualified_name", "is_test", "call_count")


def _walk(edge: str, src: str, dst: str, seeds: str, most: int, start: int = 0) -> str:
    return f"walk(node, depth) AS ({seeds} UNION SELECT e.{dst}, w.depth + 1 FROM walk w JOIN {edge} e ON e.{src} = w.node WHERE w.depth < {most})"


def _impact(p, edges, max_depth: int = G.DEFAULT_DEPTH):
    seeds = p.spark.createDataFrame([(ROOT,)], "node long")
    return G.reach(edges, "callee_symbol_id", "caller_symbol_id", seeds, max_depth).join(p.symbols.select(F.col("id").alias("node"), "qualified_name"), "node").select(F.col("node").alias("id"), "qualified_name", F.col("depth").cast("int").alias("depth"))


IMPACT = " SELECT s.id, s.qualified_name, CAST(min(w.depth) AS INT) AS depth FROM walk w JOIN symbols s ON s.id = w.node WHERE w.depth > 0 GROUP BY s.id, s.qualified_name"


@query(IMPACT, _walk("call_edges", "callee_symbol_id", "caller_symbol_id", f"SELECT CAST({ROOT} AS BIGINT), 0", G.DEFAULT_DEPTH))
def symbol_impact(p):
    return _impact(p, _edges(p))


@query(IMPACT, _walk(f"(SELECT c.* FROM call_edges c JOIN {FIRM} f ON f.x = c.caller_symbol_id AND f.y = c.callee_symbol_id)", "callee_symbol_id", "caller_symbol_id", f"SELECT CAST({ROOT} AS BIGINT), 0", G.DEFAULT_DEPTH))
def symbol_impact_excl_spec(p):
    return _impact(p, E.supported_edges(_edges(p), schema.refs_banded(p.refs, p.symbols)))


@query(" SELECT * FROM file_deps")
def file_deps(p):
    return _deps(p)


def _file_crates(p):
    return p.file_packages.join(p.packages.select(F.col("id").alias("package_id"), F.col("name").alias("crate"), F.col("path").alias("crate_path")), "package_id").select("file_id", "crate", "crate_path")


CRATE_IMPORTS = "(SELECT DISTINCT i.file_id, k.name AS crate FROM imports i JOIN packages k ON k.name = split_part(i.source_module, '::', 1))"


@query(f""" SELECT d.* FROM file_deps d JOIN file_packages a ON a.file_id = d.from_file_id JOIN file_packages b ON b.file_id = d.to_file_id
JOIN packages q ON q.id = b.package_id LEFT JOIN {CRATE_IMPORTS} c ON c.file_id = d.from_file_id AND c.crate = q.name
WHERE a.package_id = b.package_id OR c.crate IS NOT NULL""")
def file_deps_corroborated(p):
    return E.corroborated(_deps(p), _file_crates(p), E.imported_crates(p.imports, p.packages))


@query(" SELECT DISTINCT d.from_file_id, d.to_file_id FROM file_deps d WHERE EXISTS (SELECT 1 FROM symbols a JOIN symbols b ON b.name = a.name WHERE a.file_id = d.from_file_id - 1 AND b.file_id = d.to_file_id AND a.kind = 'trait' AND b.kind = 'trait')")
def file_deps_csharp(p):
    """As if all files were C#, each trait a namespace that its file declares and the next file uses."""
    spaces = p.symbols.withColumn("kind", F.when(F.col("kind") == "trait", "module").otherwise("function"))
    uses = p.symbols.where("kind = 'trait'").select((F.col("file_id") + 1).alias("file_id"), F.col("name").alias("source_module"))
    return E.csharp_corroboration(_deps(p), uses, spaces, p.files.withColumn("language", F.lit("csharp")))


@query(f" SELECT DISTINCT i.file_id, k.name AS crate FROM imports i JOIN packages k ON k.name = split_part(i.source_module, '::', 1)")
def imports_per_crate(p):
    return E.imported_crates(p.imports, p.packages)


MODULES = "(SELECT 'pkg_' || CAST(id DIV 6 AS STRING) || '::m' || CAST(id % 40 AS STRING) AS module, min(id) AS file_id FROM files GROUP BY 1)"


def _modules(p):
    name = F.concat(F.lit("pkg_"), F.floor(F.col("id") / 6).cast("string"), F.lit("::m"), (F.col("id") % 40).cast("string"))
    return p.files.groupBy(name.alias("module")).agg(F.min("id").alias("file_id"))


@query(f""" SELECT DISTINCT i.file_id AS from_file_id, m.file_id AS to_file_id, CAST(1 AS INT) AS ref_count FROM imports i JOIN {MODULES} m ON m.module = i.source_module
WHERE i.symbol_name <> '*' AND i.file_id <> m.file_id AND EXISTS (SELECT 1 FROM (SELECT DISTINCT file_id, name FROM refs_named) r WHERE r.file_id = i.file_id AND r.name = coalesce(i.alias, i.symbol_name))""")
def import_dependencies(p):
    named = schema.refs_named(p.refs, p.symbols).select("file_id", "name").distinct()
    return E.import_dependencies(p.imports, named, _modules(p))


@query(" SELECT CAST(w.node AS BIGINT) AS file_id, CAST(min(w.depth) AS INT) AS depth FROM walk w WHERE w.depth > 0 GROUP BY w.node", _walk("file_deps", "to_file_id", "from_file_id", f"SELECT CAST({LEAF} AS BIGINT), 0", G.DEFAULT_DEPTH))
def file_impact(p):
    seeds = p.spark.createDataFrame([(LEAF,)], "node long")
    return G.reach(_deps(p), "to_file_id", "from_file_id", seeds, G.DEFAULT_DEPTH).select(F.col("node").alias("file_id"), "depth")


def _paths(p, src, dst, depth):
    names = p.symbols.select(F.col("id").alias("node"), F.col("qualified_name").alias("name"))
    out = G.reach_paths(_edges(p), src, dst, ROOT, names, depth)
    return out.select(F.col("node").alias("id"), "depth", F.size("path").alias("hops"))


def _reach_sql(src, dst, depth):
    return " SELECT CAST(w.node AS BIGINT) AS id, CAST(min(w.depth) AS INT) AS depth, CAST(min(w.depth) + 1 AS INT) AS hops FROM walk w WHERE w.node <> 315 GROUP BY w.node", _walk("call_edges", src, dst, f"SELECT CAST({ROOT} AS BIGINT), 0", depth)


@query(*_reach_sql("caller_symbol_id", "callee_symbol_id", G.DEFAULT_DEPTH))
def reachable_fwd(p):
    return _paths(p, "caller_symbol_id", "callee_symbol_id", G.DEFAULT_DEPTH)


@query(*_reach_sql("callee_symbol_id", "caller_symbol_id", G.DEFAULT_DEPTH))
def reachable_bwd(p):
    return _paths(p, "callee_symbol_id", "caller_symbol_id", G.DEFAULT_DEPTH)


@query(f" SELECT CAST(min(w.depth) + 1 AS BIGINT) AS files, CAST({CHAIN[0]} AS BIGINT) AS first, CAST({CHAIN[1]} AS BIGINT) AS last FROM walk w WHERE w.node = {CHAIN[1]}", _walk("file_deps", "from_file_id", "to_file_id", f"SELECT CAST({CHAIN[0]} AS BIGINT), 0", 50))
def dependency_chain(p):
    names = p.files.select(F.col("id").alias("node"), F.col("path").alias("name"))
    chain = G.dependency_chain(_deps(p), "from_file_id", "to_file_id", *CHAIN, names)
    return chain.agg(F.count("*").alias("files"), F.min_by("node", "position").alias("first"), F.max_by("node", "position").alias("last"))


CYCLES = "ways(start, node, path) AS (SELECT from_file_id, to_file_id, [from_file_id, to_file_id] FROM file_deps WHERE to_file_id >= from_file_id UNION ALL SELECT w.start, d.to_file_id, list_append(w.path, d.to_file_id) FROM ways w JOIN file_deps d ON d.from_file_id = w.node WHERE w.node <> w.start AND d.to_file_id >= w.start AND (d.to_file_id = w.start OR NOT list_contains(w.path, d.to_file_id)))"


@query(" SELECT list_aggregate(list_sort(path[1:len(path) - 1]), 'string_agg', ',') AS members, CAST(len(path) - 1 AS INT) AS length FROM ways WHERE node = start", CYCLES)
def cycles(p):
    return G.detect_cycles(_deps(p), p.files).select(F.array_join(F.array_sort("ids").cast("array<string>"), ",").alias("members"), "length")


#: From each node m the walk keeps to nodes not below it: forth has what m reaches so, back what of that reaches m.
#: The least m that has a node in back is the least node of its component.
FORTH = """forth(m, n) AS (SELECT from_file_id, to_file_id FROM file_deps WHERE to_file_id >= from_file_id UNION SELECT f.m, d.to_file_id FROM forth f JOIN file_deps d ON d.from_file_id = f.n WHERE d.to_file_id >= f.m),
back(m, n) AS (SELECT f.m, f.n FROM forth f JOIN file_deps d ON d.from_file_id = f.n AND d.to_file_id = f.m UNION SELECT b.m, d.from_file_id FROM back b JOIN file_deps d ON d.to_file_id = b.n JOIN forth f ON f.m = b.m AND f.n = d.from_file_id)"""


@query(" SELECT node, scc, CAST(count(*) OVER (PARTITION BY scc) AS BIGINT) AS size FROM (SELECT n AS node, min(m) AS scc FROM back GROUP BY n)", FORTH)
def scc(p):
    return G.strong_components(_deps(p).select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst")))


@query(" SELECT name, CAST(count(*) AS BIGINT) AS n FROM refs_named GROUP BY name")
def refs_named(p):
    return schema.refs_named(p.refs, p.symbols).groupBy("name").agg(F.count("*").alias("n"))


@query(f" SELECT in_symbol_id, kind, line, name, strategy, {BAND} AS band FROM refs_named")
def refs_banded(p):
    return schema.refs_banded(p.refs, p.symbols).select("in_symbol_id", "kind", "line", "name", "strategy", "band")


@query(f" SELECT strategy, {BAND} AS band, CAST(count(*) AS BIGINT) AS n FROM refs GROUP BY 1, 2")
def strategy_histogram(p):
    return p.refs.groupBy("strategy").agg(F.count("*").alias("n")).select("strategy", schema.band(F.col("strategy")).alias("band"), "n")


@query(" SELECT id, qualified_name FROM symbols WHERE name ILIKE '%SYM_12%' OR qualified_name ILIKE '%SYM_12%' ORDER BY CASE WHEN name = 'SYM_12' THEN 0 ELSE 1 END, length(qualified_name), id LIMIT 100")
def search_symbols(p):
    return L.search_symbols(p.symbols, "SYM_12", 100).select("id", "qualified_name")


@query(" SELECT id, name, line FROM symbols WHERE file_id = 7")
def symbols_in_file(p):
    return L.symbols_in_file(p.symbols, 7).select("id", "name", "line")


@query(" SELECT min(id) AS id, qualified_name FROM symbols WHERE qualified_name = 'sym_10::sym_11' GROUP BY qualified_name")
def symbol_by_name(p):
    return L.symbol_by_name(p.symbols, "sym_10::sym_11").select("id", "qualified_name")


@query(" SELECT id, name FROM symbols WHERE kind = 'trait' ORDER BY id LIMIT 25")
def symbols_by_kind(p):
    return L.symbols_by_kind(p.symbols, "trait", 25).select("id", "name")


@query(" SELECT id, file_id, line FROM symbols WHERE is_test")
def symbols_tests(p):
    return L.test_symbols(p.symbols).select("id", "file_id", "line")


@query(f" SELECT in_symbol_id, kind, line FROM refs WHERE symbol_id = {ROOT}")
def references_to(p):
    return L.references_to(p.refs, ROOT).select("in_symbol_id", "kind", "line")


@query(" SELECT in_symbol_id, kind, line, reference_name FROM refs WHERE file_id = 7")
def references_in_file(p):
    return L.references_in_file(p.refs, 7).select("in_symbol_id", "kind", "line", "reference_name")


@query(" SELECT symbol_name, source_module, alias FROM imports WHERE file_id = 60")
def imports_in_file(p):
    return L.imports_in_file(p.imports, 60).select("symbol_name", "source_module", "alias")


@query(" SELECT DISTINCT r.file_id, r.line, s.id AS symbol_id FROM (SELECT DISTINCT file_id, line FROM refs) r JOIN symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.line AND s.end_line")
def symbol_containing_line(p):
    return L.innermost_symbol(p.symbols, p.refs)


#: Spans that nest: every symbol but the first ones of a file stands in those before it, and each second line has two that begin there.
NESTED = "(SELECT id, file_id, CAST((id % 10) DIV 2 * 20 + 1 AS INT) AS line, CAST(100 - (id % 2) AS INT) AS end_line FROM symbols)"


@query(f" SELECT file_id, line, symbol_id FROM (SELECT r.file_id, r.line, s.id AS symbol_id, row_number() OVER (PARTITION BY r.file_id, r.line ORDER BY s.line DESC, s.end_line, s.id) AS k FROM (SELECT DISTINCT file_id, line FROM refs) r JOIN {NESTED} s ON s.file_id = r.file_id AND r.line BETWEEN s.line AND s.end_line) x WHERE k = 1")
def symbol_containing_line_nested(p):
    spans = p.symbols.withColumns({"line": F.expr("CAST((id % 10) DIV 2 * 20 + 1 AS INT)"), "end_line": F.expr("CAST(100 - (id % 2) AS INT)")})
    return L.innermost_symbol(spans, p.refs)


@query(" SELECT DISTINCT r.file_id, s.line, s.id AS symbol_id FROM refs r JOIN symbols s ON s.file_id = r.file_id AND r.line - 3 = s.line")
def symbol_at_line(p):
    return L.symbol_at_line(p.symbols, p.refs.withColumn("line", F.col("line") - 3))


@query(" SELECT d.to_file_id AS file_id, f.path, d.ref_count FROM file_deps d LEFT JOIN files f ON f.id = d.to_file_id WHERE d.from_file_id = 60")
def file_dependencies(p):
    return L.file_neighbours(_deps(p), p.files, 60)


@query(" SELECT d.from_file_id AS file_id, f.path, d.ref_count FROM file_deps d LEFT JOIN files f ON f.id = d.from_file_id WHERE d.to_file_id = 30")
def file_dependents(p):
    return L.file_neighbours(_deps(p), p.files, 30, dependents=True)


@query(" SELECT language AS value, CAST(count(*) AS BIGINT) AS count FROM files GROUP BY language")
def stats_files(p):
    return L.counts_by(p.files, "language", list(schema.LANGUAGES.values()))


@query(" SELECT kind AS value, CAST(count(*) AS BIGINT) AS count FROM symbols GROUP BY kind")
def stats_symbols(p):
    return L.counts_by(p.symbols, "kind", schema.SYMBOL_KINDS)


@query(" SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM file_deps) AS file_deps")
def stats_totals(p):
    return L.stats(p.files, p.symbols, p.refs, _deps(p)).select("files", "symbols", "refs", "file_deps")


@query(" SELECT * FROM package_deps")
def package_deps(p):
    return _package_deps(p)


COUPLING = """ SELECT k.name, coalesce(i.n, 0) AS afferent, coalesce(o.n, 0) AS efferent, CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(o.n, 0)::DOUBLE / (coalesce(i.n, 0) + coalesce(o.n, 0)), 6) END AS instability
FROM packages k LEFT JOIN (SELECT target_pkg, count(*) AS n FROM package_deps GROUP BY 1) i ON i.target_pkg = k.id LEFT JOIN (SELECT source_pkg, count(*) AS n FROM package_deps GROUP BY 1) o ON o.source_pkg = k.id"""


@query(COUPLING)
def coupling(p):
    return L.coupling_table(schema.coupling(p.packages, _package_deps(p))).select("name", "afferent", "efferent", F.round("instability", 6).alias("instability"))


@query(" SELECT 'in' AS direction, k.name, d.dep_count FROM package_deps d JOIN packages k ON k.id = d.source_pkg WHERE d.target_pkg = 10 UNION ALL SELECT 'out', k.name, d.dep_count FROM package_deps d JOIN packages k ON k.id = d.target_pkg WHERE d.source_pkg = 10")
def coupling_detail(p):
    return L.package_neighbours(_package_deps(p), p.packages, 10)


PANICS = "(SELECT f.path, r.line, CASE WHEN r.name = 'unwrap' OR r.name LIKE '%::unwrap' THEN 'unwrap' WHEN r.name = 'expect' OR r.name LIKE '%::expect' THEN 'expect' END AS kind, s.id AS symbol_id, s.is_test FROM refs_named r JOIN symbols s ON s.id = r.in_symbol_id AND s.kind IN ('function', 'method') JOIN files f ON f.id = r.file_id WHERE r.kind = 'call')"


@query(f" SELECT * FROM {PANICS} x WHERE kind IS NOT NULL AND NOT is_test")
def panic_points(p):
    return N.panic_points(schema.refs_named(p.refs, p.symbols), p.symbols, p.files).drop("qualified_name")


@query(f" SELECT CAST(count(*) FILTER (NOT is_test) AS BIGINT) AS production, CAST(count(*) FILTER (is_test) AS BIGINT) AS test FROM {PANICS} x WHERE kind IS NOT NULL")
def panic_counts(p):
    return N.panic_counts(N.panic_points(schema.refs_named(p.refs, p.symbols), p.symbols, p.files, include_tests=True))


@query(" SELECT a.symbol_id, s.name, s.qualified_name, s.file_id, a.name AS attribute, CASE WHEN a.name = 'deprecated' THEN regexp_extract(a.args, 'since = \"([^\"]*)\"', 1) END AS since, 'use another' AS note FROM attributes a JOIN symbols s ON s.id = a.symbol_id")
def deprecated_symbols(p):
    return N.deprecated_symbols(p.attributes, p.symbols)


DEP = """(SELECT a.symbol_id, s.name, f.language, (SELECT count(*) FROM symbols t JOIN files g ON g.id = t.file_id WHERE t.name = s.name AND g.language = f.language) AS twins FROM attributes a JOIN symbols s ON s.id = a.symbol_id JOIN files f ON f.id = s.file_id)"""


@query(f""" SELECT d.symbol_id, x.ref_file_id, x.line, x.in_symbol_id, x.tier, x.via FROM {DEP} d LEFT JOIN (
SELECT r.symbol_id, r.file_id AS ref_file_id, r.line, r.in_symbol_id, CASE WHEN e.twins > 1 THEN 'maybe' ELSE 'definite' END AS tier, 'resolved' AS via FROM refs r JOIN {DEP} e ON e.symbol_id = r.symbol_id
UNION ALL SELECT e.symbol_id, r.file_id, r.line, r.in_symbol_id, 'maybe', 'unresolved-qualified' FROM refs r JOIN files g ON g.id = r.file_id JOIN {DEP} e ON e.name = string_split(r.reference_name, '::')[-1] AND e.language = g.language WHERE r.symbol_id IS NULL AND contains(r.reference_name, '::')
) x ON x.symbol_id = d.symbol_id""")
def deprecated_callers(p):
    return N.deprecated_callers(N.deprecated_symbols(p.attributes, p.symbols), p.refs, p.symbols, p.files)


@query(""" SELECT s.id, s.qualified_name, CASE WHEN t.n > 1 THEN 'maybe' ELSE 'definite' END AS tier
FROM symbols s JOIN files f ON f.id = s.file_id JOIN file_packages o ON o.file_id = s.file_id JOIN (SELECT name, count(*) AS n FROM symbols GROUP BY name) t ON t.name = s.name
LEFT JOIN (SELECT string_split(r.reference_name, '::')[-1] AS name, min(o.package_id) AS low, max(o.package_id) AS high FROM refs r JOIN file_packages o ON o.file_id = r.file_id WHERE r.symbol_id IS NULL AND contains(r.reference_name, '::') GROUP BY 1) u ON u.name = s.name
WHERE s.visibility = 'public' AND s.parent_symbol_id IS NULL AND f.language = 'rust'
AND NOT EXISTS (SELECT 1 FROM refs r JOIN file_packages q ON q.file_id = r.file_id WHERE r.symbol_id = s.id AND q.package_id <> o.package_id)
AND NOT EXISTS (SELECT 1 FROM imports i JOIN file_packages q ON q.file_id = i.file_id JOIN packages k ON k.name = split_part(i.source_module, '::', 1) WHERE i.symbol_name = s.name AND k.id = o.package_id AND q.package_id <> o.package_id)
AND NOT EXISTS (SELECT 1 FROM imports i JOIN file_packages q ON q.file_id = i.file_id JOIN packages k ON k.name = split_part(i.source_module, '::', 1) WHERE i.symbol_name = '*' AND 'crate::' || split_part(i.source_module, '::', 2) = s.module_path AND k.id = o.package_id AND q.package_id <> o.package_id)
AND NOT coalesce(u.low <> o.package_id OR u.high <> o.package_id, false)""")
def visibility_candidates(p):
    return N.visibility_candidates(p.symbols, p.refs, p.imports, p.files, p.file_packages, p.packages, workspace_closed=True).select("id", "qualified_name", "tier")


@query(" SELECT id, qualified_name FROM symbols WHERE kind IN ('function', 'method') AND id NOT IN (SELECT node FROM walk)", "walk(node) AS (SELECT id FROM symbols WHERE is_test UNION SELECT r.symbol_id FROM walk w JOIN refs r ON r.in_symbol_id = w.node WHERE r.symbol_id IS NOT NULL)")
def untested_code(p):
    return N.untested_code(p.refs, p.symbols)[0].select("id", "qualified_name")


LIVE = "live(id) AS (SELECT DISTINCT symbol_id FROM refs WHERE symbol_id IS NOT NULL AND in_symbol_id IS DISTINCT FROM symbol_id UNION SELECT in_symbol_id FROM refs WHERE kind = 'inherit'), walk(node) AS (SELECT s.parent_symbol_id FROM live l JOIN symbols s ON s.id = l.id WHERE s.parent_symbol_id IS NOT NULL UNION SELECT s.parent_symbol_id FROM walk w JOIN symbols s ON s.id = w.node WHERE s.parent_symbol_id IS NOT NULL)"
DEAD = """SELECT s.id, f.path, s.line, s.end_line, s.name, s.kind, f.language FROM symbols s JOIN files f ON f.id = s.file_id
WHERE s.visibility <> 'public' AND NOT s.is_test AND (CASE WHEN f.language = 'rust' THEN s.kind IN ('function', 'method', 'struct', 'trait') ELSE s.kind IN ('function', 'method', 'struct') END)
AND s.id NOT IN (SELECT id FROM live) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.symbol_id IS NULL AND string_split(r.reference_name, '::')[-1] = s.name AND r.in_symbol_id <> s.id)
AND NOT (s.kind IN ('struct', 'trait') AND s.id IN (SELECT node FROM walk))"""


@query(" " + DEAD, LIVE)
def dead_code_candidates(p):
    return N.dead_code(p.symbols, p.refs, p.files)


QUERIES["dead_code_tiered"] = lambda spark, sf_dir: _dead_tiered(Projected(spark, sf_dir), spark, sf_dir)


def _dead_tiered(p, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), F.col("text").alias("content"))
    dead = N.dead_code(p.symbols, p.refs, p.files)
    # names that documents can hold: a word of the corpus stands for each symbol
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("w"), F.lower(F.regexp_extract("text", "([A-Za-z]{4,})", 1)).alias("word"))
    named = dead.join(words, dead["id"] % 40 == words["w"]).drop("name", "w").withColumnRenamed("word", "name")
    return N.tiered_dead_code(named, docs).select("id", "name", "tier")


ORACLES["dead_code_tiered"] = duck(f""" SELECT d.id, w.word AS name, CASE WHEN EXISTS (SELECT 1 FROM documents t WHERE regexp_matches(t.text, '(^|[^A-Za-z0-9_])' || w.word || '([^A-Za-z0-9_]|$)')) THEN 'maybe' ELSE 'definite' END AS tier
FROM ({DEAD}) d JOIN (SELECT item_id, lower(regexp_extract(text, '([A-Za-z]{{4,}})', 1)) AS word FROM benchmark) w ON w.item_id = d.id % 40""", LIVE)


def _hierarchy(p, direction):
    return G.type_hierarchy("sym_395", direction, p.refs, p.symbols).select("symbol_id", "name", F.col("depth").cast("int").alias("depth"))


BOX = "(SELECT id FROM symbols WHERE kind IN ('struct', 'trait'))"
INHERIT = f"(SELECT r.in_symbol_id AS sub, r.symbol_id AS super, r.reference_name FROM refs r WHERE r.kind = 'inherit' AND r.in_symbol_id IN {BOX})"
ROOTS = "SELECT id, 0 FROM symbols WHERE name = 'sym_395' AND kind IN ('struct', 'trait')"


@query(f""" SELECT w.node AS symbol_id, s.name, CAST(min(w.depth) AS INT) AS depth FROM walk w JOIN symbols s ON s.id = w.node WHERE w.node NOT IN (SELECT id FROM symbols WHERE name = 'sym_395' AND kind IN ('struct', 'trait')) GROUP BY w.node, s.name
UNION ALL SELECT NULL, i.reference_name, CAST(min(w.depth) + 1 AS INT) FROM (SELECT node, min(depth) AS depth FROM walk GROUP BY node) w JOIN {INHERIT} i ON i.sub = w.node WHERE i.super IS NULL AND i.reference_name IS NOT NULL AND w.depth < 50 GROUP BY i.reference_name""", f"walk(node, depth) AS ({ROOTS} UNION SELECT i.super, w.depth + 1 FROM walk w JOIN {INHERIT} i ON i.sub = w.node WHERE i.super IS NOT NULL AND w.depth < 50)")
def type_hierarchy_up(p):
    return _hierarchy(p, "up")


@query(" SELECT w.node AS symbol_id, s.name, CAST(min(w.depth) AS INT) AS depth FROM walk w JOIN symbols s ON s.id = w.node WHERE w.node NOT IN (SELECT id FROM symbols WHERE name = 'sym_395' AND kind IN ('struct', 'trait')) GROUP BY w.node, s.name", f"walk(node, depth) AS ({ROOTS} UNION SELECT i.sub, w.depth + 1 FROM walk w JOIN {INHERIT} i ON i.super = w.node WHERE w.depth < 50)")
def type_hierarchy_down(p):
    return _hierarchy(p, "down")


@query(" SELECT id, file_id FROM symbols WHERE is_test AND file_id IN (SELECT node FROM walk)", "walk(node) AS (SELECT CAST(20 AS BIGINT) UNION SELECT d.from_file_id FROM walk w JOIN file_deps d ON d.to_file_id = w.node)")
def affected_tests(p):
    changed = p.spark.createDataFrame([(20,)], "file_id long")
    return N.affected_tests(changed, _deps(p), p.symbols).select("id", "file_id")


def _listings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    row = [F.concat(F.lit("u_"), "user_id").alias("path"), F.max("event_id").alias("mtime_ns"), F.count("*").alias("size_bytes")]
    return (e.where(f"event_id % 2 = {k}").groupBy("user_id").agg(*row[1:]).select(row[0], "mtime_ns", "size_bytes") for k in (0, 1))


QUERIES["staleness"] = lambda spark, sf_dir: N.staleness(*_listings(spark, sf_dir))
ORACLES["staleness"] = """WITH a AS (SELECT 'u_' || user_id AS path, max(event_id) AS m, count(*) AS s FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT 'u_' || user_id AS path, max(event_id) AS m, count(*) AS s FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m OR a.s <> b.s"""


def _standing(spark, sf_dir):
    a, b = _listings(spark, sf_dir)
    inputs = spark.range(0, 60).select(F.col("id").alias("ordinal"), F.concat(F.lit("u_"), F.col("id") * 7).alias("path"))
    return N.query_standing(inputs, a, b)


QUERIES["query_standing"] = _standing
ORACLES["query_standing"] = """WITH a AS (SELECT 'u_' || user_id AS path, max(event_id) AS m, count(*) AS s FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT 'u_' || user_id AS path, max(event_id) AS m, count(*) AS s FROM events WHERE event_id % 2 = 1 GROUP BY user_id),
i AS (SELECT CAST(range AS BIGINT) AS ordinal, 'u_' || (range * 7) AS path FROM range(60))
SELECT i.ordinal, i.path, CASE WHEN a.path IS NULL THEN 'unindexed' ELSE 'stale' END AS reason FROM i LEFT JOIN a ON a.path = i.path LEFT JOIN b ON b.path = i.path WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m OR a.s <> b.s
UNION ALL SELECT CAST(2147483647 AS BIGINT), NULL, 'stale-index' WHERE EXISTS (SELECT 1 FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m OR a.s <> b.s)"""

NAMES = "(SELECT DISTINCT file_id, reference_name AS name FROM refs WHERE symbol_id IS NULL AND reference_name IS NOT NULL)"
SEGMENT = "split_part(n.name, '::', 1)"


def _names(p):
    return R.distinct_names(p.refs)


@query(" SELECT in_symbol_id, line, kind, reference_name FROM refs WHERE symbol_id IS NULL")
def unresolved_refs(p):
    return p.refs.where("symbol_id is null").select("in_symbol_id", "line", "kind", "reference_name")


#: A qualified name must be the whole qualified name of a symbol in the file, a simple one its name.
IN_FILE = "CASE WHEN contains(n.name, '::') THEN s.qualified_name = {t} ELSE s.name = {t} END"


@query(f""" SELECT n.file_id, n.name, min(s.id) AS symbol_id FROM {NAMES} n
JOIN (SELECT * FROM (SELECT file_id, coalesce(alias, symbol_name) AS key, symbol_name, source_module, row_number() OVER (PARTITION BY file_id, coalesce(alias, symbol_name) ORDER BY source_module DESC, symbol_name DESC) AS k FROM imports WHERE symbol_name <> '*') y WHERE k = 1) i ON i.file_id = n.file_id AND i.key = {SEGMENT}
JOIN {MODULES} m ON m.module = i.source_module JOIN symbols s ON s.file_id = m.file_id AND {IN_FILE.format(t=f"(i.symbol_name || substr(n.name, length({SEGMENT}) + 1))")} GROUP BY n.file_id, n.name""")
def resolve_explicit_import(p):
    return R.explicit_import(_names(p), p.imports, _modules(p), p.symbols)


GLOB = f"""SELECT n.file_id, n.name, i.source_module, s.id FROM {NAMES} n JOIN files f ON f.id = n.file_id AND f.language = 'rust' JOIN imports i ON i.file_id = n.file_id AND i.symbol_name = '*'
JOIN {MODULES} m ON m.module = i.source_module JOIN symbols s ON s.file_id = m.file_id AND {IN_FILE.format(t="n.name")}"""


@query(f" SELECT file_id, name, arg_min(id, (source_module, id)) AS symbol_id FROM ({GLOB}) g GROUP BY file_id, name")
def resolve_glob_import(p):
    return R.glob_import(_names(p), p.imports, _modules(p), p.symbols, p.files)


@query(f""" SELECT n.file_id, n.name, min(s.id) AS symbol_id FROM {NAMES} n JOIN files f ON f.id = n.file_id AND f.language = 'csharp' JOIN (SELECT DISTINCT file_id, source_module FROM imports WHERE symbol_name = '*') i ON i.file_id = n.file_id
JOIN {MODULES} m ON m.module = i.source_module JOIN symbols s ON s.file_id = m.file_id AND s.name = n.name AND s.kind IN ('struct', 'trait') WHERE NOT contains(n.name, '::') GROUP BY n.file_id, n.name HAVING count(DISTINCT s.id) = 1""")
def resolve_import_union(p):
    return R.import_union(_names(p), p.imports, _modules(p).withColumnRenamed("module", "namespace"), p.symbols, p.files)


@query(f" SELECT n.file_id, n.name, min(s.id) AS symbol_id FROM {NAMES} n JOIN symbols s ON s.qualified_name = n.name WHERE contains(n.name, '::') GROUP BY n.file_id, n.name")
def resolve_qualified_exact(p):
    return R.qualified_exact(_names(p), p.symbols)


@query(f" SELECT n.file_id, n.name, min(s.id) AS symbol_id FROM {NAMES} n JOIN file_packages a ON a.file_id = n.file_id JOIN file_packages b ON b.package_id = a.package_id JOIN symbols s ON s.file_id = b.file_id AND s.name = n.name WHERE NOT contains(n.name, '::') GROUP BY n.file_id, n.name HAVING count(*) = 1")
def resolve_same_crate(p):
    return R.same_crate(_names(p), p.symbols, _file_crates(p))


@query(f" SELECT n.file_id, n.name, min(s.id) AS symbol_id FROM {NAMES} n JOIN symbols s ON s.name = n.name WHERE NOT contains(n.name, '::') GROUP BY n.file_id, n.name HAVING count(*) = 1")
def resolve_unique_workspace(p):
    return R.unique_workspace(_names(p), p.symbols)


SHORT = "(SELECT 'm' || CAST(id % 40 AS STRING) AS module, min(id) AS file_id FROM files GROUP BY 1)"


@query(f" SELECT n.file_id, n.name, min(s.id) AS symbol_id FROM {NAMES} n JOIN {SHORT} m ON m.module = {SEGMENT} JOIN symbols s ON s.file_id = m.file_id AND s.qualified_name = substr(n.name, length({SEGMENT}) + 3) GROUP BY n.file_id, n.name")
def resolve_qualified_fallback(p):
    short = p.files.groupBy(F.concat(F.lit("m"), (F.col("id") % 40).cast("string")).alias("module")).agg(F.min("id").alias("file_id"))
    return R.qualified_fallback(_names(p), short, p.symbols)


@query(f""" SELECT n.file_id, n.name, CASE WHEN q.id IS NOT NULL THEN q.id WHEN c.id IS NOT NULL THEN c.id ELSE u.id END AS symbol_id, CASE WHEN q.id IS NOT NULL THEN 'qualified_exact' WHEN c.id IS NOT NULL THEN 'same_crate' ELSE 'unique_workspace' END AS strategy
FROM (SELECT file_id, reference_name AS name, arg_min(CASE WHEN kind IN ('call', 'construct') THEN 'code' WHEN kind = 'inherit' THEN 'container' ELSE 'any' END, (line, CASE WHEN kind IN ('call', 'construct') THEN 'code' WHEN kind = 'inherit' THEN 'container' ELSE 'any' END)) AS gate FROM refs WHERE symbol_id IS NULL AND reference_name IS NOT NULL GROUP BY 1, 2) n
LEFT JOIN (SELECT x.name, x.id, s.kind FROM (SELECT qualified_name AS name, min(id) AS id FROM symbols GROUP BY 1) x JOIN symbols s ON s.id = x.id) q ON q.name = n.name AND contains(n.name, '::') AND CASE n.gate WHEN 'code' THEN q.kind <> 'struct_field' WHEN 'container' THEN q.kind IN ('struct', 'trait') ELSE true END
LEFT JOIN (SELECT o.package_id, s.name, min(s.id) AS id, min(s.kind) AS kind FROM symbols s JOIN file_packages o ON o.file_id = s.file_id GROUP BY 1, 2 HAVING count(*) = 1) c ON c.name = n.name AND c.package_id = n.file_id DIV 6 AND NOT contains(n.name, '::') AND CASE n.gate WHEN 'code' THEN c.kind <> 'struct_field' WHEN 'container' THEN c.kind IN ('struct', 'trait') ELSE true END
LEFT JOIN (SELECT name, min(id) AS id, min(kind) AS kind FROM symbols GROUP BY name HAVING count(*) = 1) u ON u.name = n.name AND NOT contains(n.name, '::') AND CASE n.gate WHEN 'code' THEN u.kind <> 'struct_field' WHEN 'container' THEN u.kind IN ('struct', 'trait') ELSE true END
WHERE q.id IS NOT NULL OR c.id IS NOT NULL OR u.id IS NOT NULL""")
def resolve_by_arms(p):
    names = settled(_names(p), "names")
    arms = {"qualified_exact": R.qualified_exact(names, p.symbols), "same_crate": R.same_crate(names, p.symbols, _file_crates(p)), "unique_workspace": R.unique_workspace(names, p.symbols)}
    return R.resolve(names, arms, p.symbols).drop("gate")


@query(" SELECT name, CAST(count(*) AS BIGINT) AS count FROM symbols GROUP BY name HAVING count(*) > 1")
def shared_names(p):
    return N.shared_names(p.symbols)


@query(" SELECT s.id, CASE WHEN t.n = 1 AND t.id <> s.id THEN t.id END AS parent_symbol_id FROM (SELECT x.id, x.file_id, y.name AS parent_name FROM symbols x JOIN symbols y ON y.file_id = x.file_id AND y.id % 10 = 0) s LEFT JOIN (SELECT file_id, name, count(*) AS n, min(id) AS id FROM symbols WHERE kind IN ('struct', 'trait') GROUP BY 1, 2) t ON t.file_id = s.file_id AND t.name = s.parent_name")
def parent_linkage(p):
    first = p.symbols.where("id % 10 = 0").select("file_id", F.col("name").alias("parent_name"))
    return R.parent_links(p.symbols.join(first, "file_id"))


@query(" SELECT CAST(count(*) AS BIGINT) AS dropped FROM refs WHERE symbol_id IS NULL AND kind = 'value'")
def noise_refs(p):
    return p.refs.agg(F.count("*").alias("all")).crossJoin(R.without_noise(p.refs).agg(F.count("*").alias("kept"))).select((F.col("all") - F.col("kept")).alias("dropped"))  # one row each


@query(" SELECT CAST(count(*) AS BIGINT) AS qualified FROM refs WHERE contains(reference_name, '::')")
def qualified_refs(p):
    return p.refs.where(is_qualified(F.col("reference_name"))).agg(F.count("*").alias("qualified"))


QUERIES |= code.QUERIES
ORACLES |= code.ORACLES
