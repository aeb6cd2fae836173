"""Extraction and binding as queries: each customer row is written out as a source file, so that SQL can say what is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.extract.stage import extract_files, first_pass
from quarry.plans.runtime import settled

#: {k}: the customer, {n}: the nation.
RUST = """use crate::m{n}::Alpha as A{k};
pub use crate::all::*;
#[deprecated(since = "{n}", note = "gone")]
pub struct S{k} {{ pub a: u8, b: T{n} }}
enum E{k} {{ One, Two(u8) }}
pub(crate) trait Tr{k} {{ fn go(&self); }}
impl Tr{k} for S{k} {{ fn go(&self) {{ helper{k}(); far{k}(); crate::m{n}::out(); }} }}
fn helper{k}() -> S{k} {{ S{k}::new() }}
#[test]
fn checks{k}() {{ helper{k}(); }}
impl S{k} {{ pub fn new() -> S{k} {{ make{n}() }} }}
"""
CSHARP = """using System;
using static Ns{n}.Tools;
namespace App{k} {{
public class C{k} : Base{n} {{
public int W {{ get; set; }}
[Obsolete("gone {n}")]
public void Go{k}() {{ Pick{k}(); var z = new Z{n}().W; Tools.Run(); }}
[Fact] public void Checks{k}() {{ Go{k}(); }}
}}
internal enum K{k} {{ A, B }}
}}
"""


def _filled(template: str):
    parts = template.replace("{k}", "\0k\0").replace("{n}", "\0n\0").replace("{{", "{").replace("}}", "}").split("\0")
    of = {"k": F.col("c_custkey").cast("string"), "n": F.col("c_nationkey").cast("string")}
    return F.concat(*[of.get(x, F.lit(x)) for x in parts if x])


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, mtime_ns, size_bytes, text): a Rust and a C# file for each customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    forms = [("rs", "rust", RUST), ("cs", "csharp", CSHARP)]
    one = [rows.select(F.concat(F.lit("src/c"), "c_custkey", F.lit(f".{end}")).alias("path"), F.lit(name).alias("language"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size_bytes"), _filled(text).alias("text")) for end, name, text in forms]
    return one[0].unionByName(one[1])


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_files(workspace(spark, sf_dir))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declarations that the scanners find."""
    s = _extracted(spark, sf_dir).select("path", F.explode("symbols").alias("s"))
    return s.select("path", "s.name", "s.kind", "s.visibility", "s.parent_name", "s.signature", "s.line", "s.end_line", "s.is_test")


def code_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uses that the scanners find."""
    r = _extracted(spark, sf_dir).select("path", F.explode("refs").alias("r"))
    return r.select("path", "r.name", "r.kind", F.array_join("r.path", "::").alias("prefix"), "r.line", F.col("r.owner.line").alias("owner_line"))


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _extracted(spark, sf_dir).select("path", F.explode("imports").alias("i"))
    return i.select("path", F.col("i.module").alias("module"), F.col("i.name").alias("name"), "i.alias", "i.line", "i.public")


def code_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _extracted(spark, sf_dir).select("path", F.explode("symbols").alias("s")).select("path", F.col("s.name").alias("symbol"), F.explode("s.attributes").alias("a"))
    return a.select("path", "symbol", "a.name", "a.args", "a.line")


def code_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses with what their own file declares for them, and the symbol they stand in: binding within files, parents and containing symbols."""
    t = first_pass(settled(_extracted(spark, sf_dir), "extracted"))
    s = t["symbols"]
    own = s.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("target"))
    inside = s.alias("s").join(s.select(F.col("id").alias("p"), F.col("name").alias("parent")), F.col("s.parent_symbol_id") == F.col("p"), "left").select(F.col("s.id").alias("in_symbol_id"), F.col("s.qualified_name").alias("within"), "parent")
    out = t["refs"].join(t["files"].select(F.col("id").alias("file_id"), "path"), "file_id").join(own, "symbol_id", "left").join(inside, "in_symbol_id", "left")
    return out.select("path", "kind", "line", "target", "reference_name", "strategy", "within", "parent")


def _rows(columns: str, rows: str, where: str = "") -> str:
    """SQL for one row of each line of `rows` for each customer; {k} and {n} stand for its keys, a lone - for null."""
    values = []
    for line in rows.strip().splitlines():
        cells = []
        for cell in (c.strip() for c in line.split("|")):
            text = "'" + cell.replace("'", "''").replace("{k}", "' || c_custkey || '").replace("{n}", "' || c_nationkey || '") + "'"
            cells.append("NULL" if cell == "-" else cell if cell.lstrip("-").isdigit() or cell in ("true", "false") else "''" if cell == "~" else text)
        values.append("SELECT " + ", ".join(f"{v} AS {c}" for v, c in zip(cells, columns.split(), strict=True)) + " FROM customer")
    return " UNION ALL ".join(values)


_SYMBOLS = """
src/c{k}.rs | S{k} | struct | public | - | - | 4 | 4 | false
src/c{k}.rs | a | struct_field | public | S{k} | u8 | 4 | 4 | false
src/c{k}.rs | b | struct_field | private | S{k} | T{n} | 4 | 4 | false
src/c{k}.rs | E{k} | enum | private | - | - | 5 | 5 | false
src/c{k}.rs | One | enum_variant | public | E{k} | - | 5 | 5 | false
src/c{k}.rs | Two | enum_variant | public | E{k} | (u8) | 5 | 5 | false
src/c{k}.rs | 0 | struct_field | private | E{k}::Two | u8 | 5 | 5 | false
src/c{k}.rs | Tr{k} | trait | crate | - | - | 6 | 6 | false
src/c{k}.rs | go | method | private | S{k} | fn go(&self) | 7 | 7 | false
src/c{k}.rs | helper{k} | function | private | - | fn helper{k}() S{k} | 8 | 8 | false
src/c{k}.rs | checks{k} | function | private | - | fn checks{k}() | 10 | 10 | true
src/c{k}.rs | new | method | public | S{k} | fn new() S{k} | 11 | 11 | false
src/c{k}.cs | App{k} | module | public | - | - | 3 | 11 | false
src/c{k}.cs | C{k} | class | public | - | - | 4 | 9 | false
src/c{k}.cs | W | property | public | C{k} | - | 5 | 5 | false
src/c{k}.cs | Go{k} | method | public | C{k} | void Go{k}() | 7 | 7 | false
src/c{k}.cs | Checks{k} | method | public | C{k} | void Checks{k}() | 8 | 8 | true
src/c{k}.cs | K{k} | enum | crate | - | - | 10 | 10 | false
"""
_REFS = """
src/c{k}.rs | T{n} | type | - | 4 | -
src/c{k}.rs | Tr{k} | inherit | S{k} | 7 | -
src/c{k}.rs | S{k} | type | - | 7 | -
src/c{k}.rs | Tr{k} | inherit | S{k} | 7 | 7
src/c{k}.rs | helper{k} | call | - | 7 | 7
src/c{k}.rs | far{k} | call | - | 7 | 7
src/c{k}.rs | out | call | crate::m{n} | 7 | 7
src/c{k}.rs | S{k} | type | - | 8 | 8
src/c{k}.rs | new | call | S{k} | 8 | 8
src/c{k}.rs | helper{k} | call | - | 10 | 10
src/c{k}.rs | S{k} | type | - | 11 | -
src/c{k}.rs | S{k} | type | - | 11 | 11
src/c{k}.rs | make{n} | call | - | 11 | 11
src/c{k}.cs | Base{n} | inherit | - | 4 | 4
src/c{k}.cs | Pick{k} | call | - | 7 | 7
src/c{k}.cs | Z{n} | construct | - | 7 | 7
src/c{k}.cs | W | field_access | - | 7 | 7
src/c{k}.cs | Run | call | Tools | 7 | 7
src/c{k}.cs | Go{k} | call | - | 8 | 8
"""
_IMPORTS = """
src/c{k}.rs | crate::m{n} | Alpha | A{k} | 1 | false
src/c{k}.rs | crate::all | * | - | 2 | true
src/c{k}.cs | System | * | - | 1 | false
src/c{k}.cs | Ns{n}.Tools | * | - | 2 | false
"""
_ATTRIBUTES = """
src/c{k}.rs | S{k} | deprecated | since = "{n}", note = "gone" | 3
src/c{k}.rs | checks{k} | test | - | 9
src/c{k}.cs | Go{k} | Obsolete | "gone {n}" | 6
src/c{k}.cs | Checks{k} | Fact | - | 8
"""
_BOUND = """
src/c{k}.rs | type | 4 | - | T{n} | - | - | -
src/c{k}.rs | inherit | 7 | Tr{k} | - | same_file | S{k} | -
src/c{k}.rs | type | 7 | S{k} | - | same_file | - | -
src/c{k}.rs | inherit | 7 | Tr{k} | - | same_file | S{k}::go | S{k}
src/c{k}.rs | call | 7 | helper{k} | - | same_file | S{k}::go | S{k}
src/c{k}.rs | call | 7 | - | far{k} | - | S{k}::go | S{k}
src/c{k}.rs | call | 7 | - | crate::m{n}::out | - | S{k}::go | S{k}
src/c{k}.rs | type | 8 | S{k} | - | same_file | helper{k} | -
src/c{k}.rs | call | 8 | S{k}::new | - | same_file | helper{k} | -
src/c{k}.rs | call | 10 | helper{k} | - | same_file | checks{k} | -
src/c{k}.rs | type | 11 | S{k} | - | same_file | - | -
src/c{k}.rs | type | 11 | S{k} | - | same_file | S{k}::new | S{k}
src/c{k}.rs | call | 11 | - | make{n} | - | S{k}::new | S{k}
src/c{k}.cs | inherit | 4 | - | Base{n} | - | C{k} | -
src/c{k}.cs | call | 7 | - | Pick{k} | - | C{k}::Go{k} | C{k}
src/c{k}.cs | construct | 7 | - | Z{n} | - | C{k}::Go{k} | C{k}
src/c{k}.cs | field_access | 7 | C{k}::W | - | same_file | C{k}::Go{k} | C{k}
src/c{k}.cs | call | 7 | - | Tools::Run | - | C{k}::Go{k} | C{k}
src/c{k}.cs | call | 8 | C{k}::Go{k} | - | same_file | C{k}::Checks{k} | C{k}
"""

QUERIES = {f.__name__: f for f in (code_symbols, code_refs, code_imports, code_attributes, code_first_pass)}
ORACLES = {
    "code_symbols": _rows("path name kind visibility parent_name signature line end_line is_test", _SYMBOLS),
    "code_refs": _rows("path name kind prefix line owner_line", _REFS),
    "code_imports": _rows("path module name alias line public", _IMPORTS),
    "code_attributes": _rows("path symbol name args line", _ATTRIBUTES),
    "code_first_pass": _rows("path kind line target reference_name strategy within parent", _BOUND),
}
