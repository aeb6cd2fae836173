"""Rules of single functions and operators on rows made by hand."""

from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import schema
from quarry.extract import csharp, rust
from quarry.functions import text as T
from quarry.operators import analyses as N
from quarry.operators import edges as E
from quarry.operators import graph as G
from quarry.operators import lookups as L
from quarry.operators import resolve as R


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    ("name", "args", "expected"),
    [
        ("deprecated", 'since = "1.2", note = "a, b"', ("1.2", "a, b")),
        ("deprecated", '= "plain"', (None, "plain")),
        ("deprecated", None, (None, None)),
        ("Obsolete", '"use \\"x\\"", true', (None, 'use "x"')),
        ("Obsolete", "message: \"m\"", (None, "m")),
    ],
)
def test_deprecation_arguments(name, args, expected):
    assert T.deprecation(name, args) == expected


@given(st.lists(st.sampled_from(["a", "b", ".", "..", "c d"]), max_size=6))
@settings(max_examples=100, deadline=None)
def test_paths_normalise_once(parts):
    once = T.normalise_path("/".join(parts))
    assert T.normalise_path(once) == once


def test_like_has_wildcards_and_no_case(spark):
    s = spark.createDataFrame([(1, "axb", "axb"), (2, "A_B", "m::A_B"), (3, "z", "z")], "id long, name string, qualified_name string")
    assert [i for (i,) in rows(L.search_symbols(s, "a_b"), "id")] == [1, 2]
    assert rows(L.search_symbols(s, ""), "id") == []


def test_bands_cover_all_strategies(spark):
    df = spark.createDataFrame([(s,) for s in [*schema.STRATEGIES, None]], "s string")
    got = dict(rows(df.select("s", schema.band(F.col("s")).alias("b")), "s", "b"))
    assert got[None] is None and got["lsp"] == "high" and got["same_file"] == "medium" and got["unique_workspace"] == "speculative"


def _cycles(edges):
    """All simple cycles by brute force, each from its least node."""
    nodes, e = sorted({n for x in edges for n in x}), set(edges)
    return sorted(p for k in range(1, len(nodes) + 1) for p in permutations(nodes, k) if p[0] == min(p) and all((a, b) in e for a, b in zip(p, p[1:] + p[:1], strict=True)))


@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=18))
@settings(max_examples=150, deadline=None)
def test_simple_cycles(edges):
    nodes = sorted({n for x in edges for n in x})
    out = {n: sorted(b for a, b in edges if a == n) for n in nodes}
    assert sorted(tuple(c) for c in G.simple_cycles(nodes, out)) == _cycles(list(edges))


def test_cycles_compare_paths_by_part(spark):
    files = spark.createDataFrame([(1, "a-b"), (2, "a/b"), (3, "c")], "id long, path string")
    deps = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 3)], "from_file_id long, to_file_id long")
    assert rows(G.ordered_cycles(G.detect_cycles(deps, files)).orderBy("cycle"), "paths") == [(["a/b", "a-b"],), (["c"],)]
    with pytest.raises(ValueError, match="unknown end"):
        G.detect_cycles(deps.union(spark.createDataFrame([(9, 1)], deps.schema)), files)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_walks_in_a_task_and_hop_by_hop_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "LOCAL_EDGES", limit)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (5, 5)], "a long, b long")
    one = spark.createDataFrame([(1,)], "node long")
    assert sorted(rows(G.reach(e, "a", "b", one, 9), "node", "depth")) == [(1, 3), (2, 1), (3, 2), (4, 1)]
    assert sorted(rows(G.reach(e, "a", "b", one, 9, keep_seeds=True), "node", "depth")) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert rows(G.reach(e, "a", "b", one, 0), "node") == []
    names = spark.createDataFrame([(2, "z"), (3, "m"), (4, "a")], "node long, name string")
    assert sorted(rows(G.reach_paths(e, "a", "b", 1, names, 9), "node", "path")) == [(2, [1, 2]), (3, [1, 4, 3]), (4, [1, 4])]
    assert sorted(rows(G.strong_components(e.toDF("src", "dst")), "node", "scc", "size")) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 1, 4), (5, 5, 1)]


def test_gate_comes_after_the_pick(spark):
    names = spark.createDataFrame([(1, "x", "code")], "file_id long, name string, gate string")
    symbols = spark.createDataFrame([(7, "property"), (8, "function")], "id long, kind string")
    pick = spark.createDataFrame([(1, "x", 7)], "file_id long, name string, symbol_id long")
    other = spark.createDataFrame([(1, "x", 8)], "file_id long, name string, symbol_id long")
    assert rows(R.resolve(names, {"same_crate": pick, "unique_workspace": other}, symbols), "symbol_id", "strategy") == [(8, "unique_workspace")]
    assert rows(R.resolve(names, {"same_crate": pick}, symbols), "symbol_id") == []


def test_longest_module_that_holds_the_rest_wins(spark):
    names = spark.createDataFrame([(1, "a::b::f", "any")], "file_id long, name string, gate string")
    modules = spark.createDataFrame([("a::b", 2), ("a", 3)], "module string, file_id long")
    symbols = spark.createDataFrame([(20, 2, "f", "B::f"), (30, 3, "f", "b::f")], "id long, file_id long, name string, qualified_name string")
    assert rows(R.qualified_fallback(names, modules, symbols), "symbol_id") == [(30,)]
    both = symbols.union(spark.createDataFrame([(40, 2, "f", "f")], symbols.schema))
    assert rows(R.qualified_fallback(names, modules, both), "symbol_id") == [(40,)]


def test_the_first_claimed_file_decides_a_split(spark):
    """A split whose first file lacks the rest is abandoned: its other file is not asked."""
    claims = spark.createDataFrame([(1, "h::f", 1, 0, 2, "f"), (1, "h::f", 1, 1, 3, "f")], "file_id long, name string, cut int, place int, target_file long, target string")
    symbols = spark.createDataFrame([(30, 3, "f", "f")], "id long, file_id long, name string, qualified_name string")
    assert rows(R.by_claims(claims, symbols), "symbol_id") == []
    assert rows(R.by_claims(claims.where("place = 1"), symbols), "symbol_id") == [(30,)]


def test_a_qualified_name_must_be_whole(spark):
    """`A::f` through an import of A is A::f of its file, not B::A::f; a simple name is any symbol of that name."""
    names = spark.createDataFrame([(1, "A::f"), (1, "g")], "file_id long, name string")
    imports = spark.createDataFrame([(1, "A", "m", None), (1, "g", "m", None)], "file_id long, symbol_name string, source_module string, alias string")
    modules = spark.createDataFrame([("m", 2)], "module string, file_id long")
    symbols = spark.createDataFrame([(10, 2, "f", "B::A::f"), (11, 2, "g", "C::g")], "id long, file_id long, name string, qualified_name string")
    assert rows(R.explicit_import(names, imports, modules, symbols), "name", "symbol_id") == [("g", 11)]
    whole = symbols.union(spark.createDataFrame([(12, 2, "f", "A::f")], symbols.schema))
    assert sorted(rows(R.explicit_import(names, imports, modules, whole), "name", "symbol_id")) == [("A::f", 12), ("g", 11)]


def test_globs_are_tried_in_the_order_they_are_written(spark):
    names = spark.createDataFrame([(1, "f")], "file_id long, name string")
    imports = spark.createDataFrame([(1, "*", "z", "a::x"), (1, "*", "y", "b::x")], "file_id long, symbol_name string, source_module string, written string")
    modules = spark.createDataFrame([("y", 2), ("z", 3)], "module string, file_id long")
    symbols = spark.createDataFrame([(20, 2, "f", "f"), (30, 3, "f", "f")], "id long, file_id long, name string, qualified_name string")
    files = spark.createDataFrame([(1, "rust")], "id long, language string")
    assert rows(R.glob_import(names, imports, modules, symbols, files), "symbol_id") == [(30,)]


def test_corroboration(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (1, 4, 1), (1, 5, 1)], "from_file_id long, to_file_id long, ref_count int")
    crates = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "file_id long, crate string")
    uses = spark.createDataFrame([(1, "b")], "file_id long, crate string")
    assert sorted(rows(E.corroborated(pairs, crates, uses), "to_file_id")) == [(2,), (3,), (5,)]


@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)).filter(lambda p: p[0] != p[1])))
@settings(max_examples=5, deadline=None)
def test_instability_is_a_share(spark, deps):
    packages = spark.createDataFrame([(i, f"p{i}", "") for i in range(8)], "id long, name string, path string")
    d = spark.createDataFrame([(a, b, 1) for a, b in deps], "source_pkg long, target_pkg long, dep_count int")
    assert all(0 <= i <= 1 for (i,) in rows(schema.coupling(packages, d), "instability"))


def test_no_tests_is_not_none(spark):
    symbols = spark.createDataFrame([(1, "function", False)], "id long, kind string, is_test boolean")
    refs = spark.createDataFrame([], "symbol_id long, in_symbol_id long")
    found, told = N.untested_code(refs, symbols)
    assert not told and rows(found, "id") == []


def test_rust_shapes():
    f = rust.extract('impl<T> Shape for Box2<T> { fn area(&self) { self.side(); helper(pick); m!(go(1)); r#"f("#; } }\npub use a::{B, c::D as E};\nenum K { A { x: u8 }, B(i8) }\n')
    assert [(s["name"], s["kind"], s["parent_name"]) for s in f.symbols] == [("area", "method", "Box2"), ("K", "enum", None), ("A", "enum_variant", "K"), ("x", "struct_field", "K::A"), ("B", "enum_variant", "K"), ("0", "struct_field", "K::B")]
    kinds = {(r["kind"], r["name"]) for r in f.refs}
    assert {("inherit", "Shape"), ("method", "side"), ("call", "helper"), ("value", "pick"), ("macro", "m"), ("macro_call", "go"), ("reexport", "B"), ("reexport", "D")} <= kinds
    assert ("call", "f") not in kinds
    assert [(i["module"], i["name"], i["alias"], i["public"]) for i in f.imports] == [("a", "B", None, True), ("a::c", "D", None, True)]


def test_csharp_shapes():
    f = csharp.extract("using X = A.B; namespace N { class C : D { protected internal int P => 1; private int a = 1, b; public C(int x) { new E.F(); q.r.S(); y.z = 1; } } }")
    assert [(s["name"], s["kind"], s["visibility"]) for s in f.symbols] == [("N", "module", "public"), ("C", "class", "private"), ("P", "property", "crate"), ("a", "struct_field", "private"), ("b", "struct_field", "private"), ("C", "method", "public")]
    assert [(r["kind"], r["path"], r["name"]) for r in f.refs] == [("inherit", None, "D"), ("construct", ["E"], "F"), ("call", ["q", "r"], "S"), ("field_access", ["y"], "z")]


def test_broken_text_is_no_failure():
    for text in ("fn (", "impl {", "}}}", 'fn f() { "', "enum E { A(", "use ;", "struct", "class {", "namespace"):
        rust.extract(text)
        csharp.extract(text)


def test_streaming_ingest(spark, tmp_path):
    from quarry.streaming.ingest import extraction_stream, latest

    src = tmp_path / "src"
    src.mkdir()
    for name, text in (("a.rs", "fn two() {}"), ("b.rs", "fn three() {} fn four() {}")):
        (src / name).write_text(text)
        extraction_stream(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c"), 1).awaitTermination()
    assert sorted((p, len(s)) for p, s in rows(latest(spark, str(tmp_path / "t")), "path", "symbols")) == [("a.rs", 1), ("b.rs", 2)]


def test_columns_in_other_encodings(spark):
    from quarry.functions import text as T

    line = "é\U0001f600x = name(rename)"
    for column in (1, 3, 7, 8, 11):
        units = T.utf16_of(line, column)
        assert T.from_utf16(line, units) == column
        assert spark.range(1).select(T.utf16_column(F.lit(line), F.lit(column))).first()[0] == units
    assert T.name_column(line, "name", 1) == 11 and T.name_column(line, "missing", 4) == 4


def test_signatures_and_numbers(spark):
    from quarry.functions import text as T

    cases = {
        "fn a()": (0, False),
        "pub fn b(&self, x: u8, y: Vec<(u8, u8)>) -> Result<(), E>": (2, True),
        "fn c(&'a mut self) -> io::Result<u8>": (0, True),
        "fn d(f: fn(u8, u8) -> u8, [a, b]: [u8; 2]) -> Option<Result<u8, E>>": (2, False),
        "struct E": (None, False),
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r["s"]: (r["n"], r["r"]) for r in df.select("s", T.parameter_count(F.col("s")).alias("n"), T.returns_result(F.col("s")).alias("r")).collect()}
    assert got == cases
    row = spark.range(1).select(T.rounded(F.lit(0.125), 2), T.bar(F.lit(0.26), 4), T.bar(F.lit(1.5), 3)).first()
    assert tuple(row) == ("0.13", "█░░░", "███")


def test_places_of_paths_and_reexports():
    """A path stands where its first part does, a re-export where its declaration begins; an alias uses the type it names."""
    found = rust.extract("pub use deep::wide;\ntype Short = Vec<Outer>;\nfn f() { one::two::three(); four(); x.five(); }\n")
    got = [(r["name"], r["kind"], r["path"], r["line"], r["column"]) for r in found.refs]
    assert ("wide", "reexport", None, 1, 1) in got and ("Outer", "type", None, 2, 18) in got
    assert ("three", "call", ["one", "two"], 3, 10) in got and ("four", "call", None, 3, 29) in got and ("five", "method", None, 3, 39) in got
    text = "class A { void M() { One.Two.Three(); var a = Four.Five; var b = new Six().Seven; Eight().Nine(); } }"
    got = {(r["name"], r["kind"], tuple(r["path"] or ()), r["column"]) for r in csharp.extract(text).refs}
    at = lambda word: text.index(word) + 1
    assert {("Three", "call", ("One", "Two"), at("One")), ("Five", "field_access", ("Four",), at("Four")), ("Six", "construct", (), at("Six")), ("Seven", "field_access", (), at("new")), ("Eight", "call", (), at("Eight")), ("Nine", "call", (), at("Eight"))} <= got
