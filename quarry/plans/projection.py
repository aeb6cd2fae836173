"""A code index projected from tables that hold no code, in SQL that both engines read but for integer division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "CASE WHEN {0} % 7 = 3 THEN 'only_' || CAST({0} AS STRING) ELSE 'sym_' || CAST({0} % 997 AS STRING) END"
#: The names that unresolved references write: some of them stand for many symbols, some for one, some for none.
SAID = "CASE WHEN {0} % 7 = 3 THEN 'only_' || CAST({0} AS STRING) ELSE 'sym_' || CAST({0} % 300 AS STRING) END"

CTES = {
    "symbols": f"""
SELECT o_orderkey AS id, o_orderkey DIV 10 AS file_id, {NAME.format("o_orderkey")} AS name,
       'crate::m' || CAST((o_orderkey DIV 10) % 40 AS STRING) AS module_path,
       CASE WHEN o_orderkey % 10 BETWEEN 1 AND 3 THEN ({NAME.format("(o_orderkey - o_orderkey % 10)")}) || '::' ELSE '' END || ({NAME.format("o_orderkey")}) AS qualified_name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'function' WHEN '2-HIGH' THEN 'method' WHEN '3-MEDIUM' THEN 'struct' WHEN '4-NOT SPECIFIED' THEN 'trait' ELSE 'struct_field' END AS kind,
       CAST(o_orderkey % 10 * 10 + 1 AS INT) AS line, CAST(o_orderkey % 10 * 10 + 10 AS INT) AS end_line,
       CASE o_orderstatus WHEN 'O' THEN 'public' WHEN 'F' THEN 'private' ELSE 'crate' END AS visibility,
       CASE WHEN o_orderkey % 10 BETWEEN 1 AND 3 THEN o_orderkey - o_orderkey % 10 END AS parent_symbol_id, o_orderkey % 17 = 0 AS is_test
FROM orders""",
    "files": """
SELECT DISTINCT o_orderkey DIV 10 AS id, 'pkg_' || CAST((o_orderkey DIV 10) DIV 6 AS STRING) || '/src/f_' || CAST(o_orderkey DIV 10 AS STRING) || CASE WHEN (o_orderkey DIV 10) % 5 = 0 THEN '.cs' ELSE '.rs' END AS path,
       CASE WHEN (o_orderkey DIV 10) % 5 = 0 THEN 'csharp' ELSE 'rust' END AS language
FROM orders""",
    "packages": "\nSELECT DISTINCT (o_orderkey DIV 10) DIV 6 AS id, 'pkg_' || CAST((o_orderkey DIV 10) DIV 6 AS STRING) AS name, 'pkg_' || CAST((o_orderkey DIV 10) DIV 6 AS STRING) AS path FROM orders",
    "file_packages": "\nSELECT DISTINCT o_orderkey DIV 10 AS file_id, (o_orderkey DIV 10) DIV 6 AS package_id FROM orders",
    "sites": """
SELECT l_orderkey AS in_symbol_id, l_partkey AS p, l_linenumber AS n, l_suppkey % 9 AS s, l_returnflag AS flag,
       CASE WHEN l_partkey % 10 = 0 AND l_linenumber = 7 THEN l_orderkey + 1 + l_partkey % 15 ELSE l_orderkey - 1 - l_partkey % 23 END AS tgt
FROM lineitem""",
    "refs": f"""
SELECT in_symbol_id, in_symbol_id DIV 10 AS file_id, CAST(in_symbol_id % 10 * 10 + 1 + n AS INT) AS line,
       CASE n WHEN 1 THEN 'call' WHEN 2 THEN 'type' WHEN 3 THEN 'construct' WHEN 4 THEN 'inherit' WHEN 5 THEN 'field_access' WHEN 6 THEN 'value' ELSE 'call' END AS kind,
       CASE WHEN ok THEN tgt END AS symbol_id,
       CASE WHEN NOT ok THEN CASE WHEN p % 40 = 0 THEN 'Option::unwrap' WHEN p % 40 = 1 THEN 'expect' WHEN p % 3 = 0 THEN ({NAME.format("(p - p % 10)")}) || '::' || ({NAME.format("p")}) WHEN p % 3 = 1 THEN 'm' || CAST(p % 40 AS STRING) || '::' || ({SAID.format("p")}) ELSE {SAID.format("p")} END END AS reference_name,
       CASE WHEN ok THEN CASE s WHEN 0 THEN 'same_file' WHEN 1 THEN 'explicit_import' WHEN 2 THEN 'glob_import' WHEN 3 THEN 'import_union' WHEN 4 THEN 'qualified_exact' WHEN 5 THEN 'same_crate' WHEN 6 THEN 'unique_workspace' WHEN 7 THEN 'qualified_module_fallback' ELSE 'lsp' END END AS strategy
FROM (SELECT in_symbol_id, p, n, s, tgt, flag <> 'R' AND tgt >= 0 AND tgt <= (SELECT max(o_orderkey) FROM orders) AS ok FROM sites) AS x""",
    "imports": f"""
SELECT DISTINCT l_orderkey DIV 10 AS file_id, CASE WHEN l_partkey % 4 = 0 THEN '*' ELSE {SAID.format("l_partkey")} END AS symbol_name,
       'pkg_' || CAST((l_orderkey DIV 10 - l_suppkey % 12) DIV 6 AS STRING) || '::m' || CAST((l_orderkey DIV 10 - l_suppkey % 12) % 40 AS STRING) AS source_module,
       CASE WHEN l_partkey % 11 = 0 THEN 'alias_' || CAST(l_partkey % 97 AS STRING) END AS alias
FROM lineitem WHERE l_linenumber IN (5, 6) AND l_orderkey DIV 10 >= 12""",
    "attributes": """
SELECT o_orderkey AS symbol_id, CASE WHEN o_custkey % 2 = 0 THEN 'deprecated' ELSE 'Obsolete' END AS name,
       CASE WHEN o_custkey % 2 = 0 THEN 'since = "1.' || CAST(o_custkey % 7 AS STRING) || '", note = "use another"' ELSE '"use another", true' END AS args
FROM orders WHERE o_custkey % 29 = 0""",
    "call_edges": """
SELECT in_symbol_id AS caller_symbol_id, symbol_id AS callee_symbol_id, CAST(count(*) AS INT) AS call_count FROM refs
WHERE symbol_id IS NOT NULL AND kind NOT IN ('value', 'field_access', 'macro_call', 'inherit') GROUP BY in_symbol_id, symbol_id""",
    "file_deps": """
SELECT a.file_id AS from_file_id, b.file_id AS to_file_id, CAST(sum(e.call_count) AS INT) AS ref_count
FROM call_edges e JOIN symbols a ON a.id = e.caller_symbol_id JOIN symbols b ON b.id = e.callee_symbol_id
WHERE a.file_id <> b.file_id GROUP BY a.file_id, b.file_id""",
    "package_deps": """
SELECT a.package_id AS source_pkg, b.package_id AS target_pkg, CAST(count(*) AS INT) AS dep_count
FROM file_deps d JOIN file_packages a ON a.file_id = d.from_file_id JOIN file_packages b ON b.file_id = d.to_file_id
WHERE a.package_id <> b.package_id GROUP BY a.package_id, b.package_id""",
    "refs_named": "\nSELECT r.*, coalesce(r.reference_name, s.name) AS name FROM refs r LEFT JOIN symbols s ON s.id = r.symbol_id",
}
BASE = ["symbols", "files", "packages", "file_packages", "sites", "refs", "imports", "attributes"]


def duck(query: str, recursive: str = "") -> str:
    """The query with the relations that it needs, for DuckDB. recursive: further relations, one of them recursive."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in reversed(CTES):
            if name not in needed and any(w == name for w in _words(text)):
                needed.append(name)
                need(CTES[name])

    need(query + recursive)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + query).replace(" DIV ", " // ")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z_]+", text)


class Projected:
    """The relations of the projection as DataFrames over one folder; derived ones come from the library's own operators."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.tables = spark, {}
        for name in ("orders", "lineitem"):
            self.tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        if name not in self.tables:
            needs = [n for n in (*BASE, "orders", "lineitem") if n != name and n in _words(CTES[name])]
            given = {n: getattr(self, n) if n in BASE else self.tables[n] for n in needs}
            query = CTES[name]
            for n in needs:
                query = _rename(query, n)
            df = self.spark.sql(query, **given)
            if name == "symbols":
                df = df.withColumns({"column": F.lit(1), "end_column": F.lit(None).cast("int"), "signature": F.lit(None).cast("string")})
            if name == "refs":
                df = df.withColumn("column", F.lit(1))
            if name == "attributes":
                df = df.withColumns({"line": F.lit(1), "id": F.col("symbol_id")})
            self.tables[name] = df
        return self.tables[name]


def _rename(query: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", query)
