"""A workspace of two crates and two C# files, from text to answers."""

import pytest

from quarry.api import Index, NotFound

FILES = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n',
    "crates/left/Cargo.toml": '[package]\nname = "left-crate"\n',
    "crates/right/Cargo.toml": '[package]\nname = "right"\n',
    "crates/right/src/lib.rs": 'pub fn far() {}\n#[deprecated(since = "2", note = "go away")]\npub fn old() {}\nfn lonely() {}\nfn twice() { twice(); }\n',
    "crates/left/src/lib.rs": "pub mod a;\npub mod b;\npub mod g;\nuse crate::a::named;\nuse crate::g::*;\nuse crate::b::Spare;\nuse right::old;\n"
    "pub fn run() { named(); starred(); near(); b::task(); Held::made(); far(); own(); old(); }\n"
    "fn own() { None::<u8>.unwrap(); }\n#[cfg(test)]\nmod tests { use super::*; #[test] fn checks() { run(); } }\n",
    "crates/left/src/a.rs": "pub fn named() {}\npub struct Held(u8);\nimpl Held { pub fn made() {} }\n",
    "crates/left/src/b.rs": "pub fn task() { near(); }\npub fn near() {}\npub struct Spare;\npub trait Shape {}\nimpl Shape for Spare {}\nimpl std::fmt::Display for Spare {}\n",
    "crates/left/src/g.rs": "use crate::b::near;\npub fn starred() { near(); }\npub fn back() { crate::run(); }\n",
    "crates/left/src/empty.rs": "",
    "crates/left/target/skipped.rs": "fn no() {}",
    "cs/Lib.cs": "namespace Lib { public static class Tools { public static void Pick() { } } public class Base { } }\n",
    "cs/Use.cs": "using Lib;\nusing static Lib.Tools;\nnamespace App { public class User : Base { public void Go() { Pick(); } [Fact] public void Checks() { Go(); } } }\n",
    "cs/Bad.cs": b"\xff\xfe\xfd",
}


def write(root, files):
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    write(root, FILES)
    index = Index(spark, str(root))
    return root, index, index.index()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_files_and_errors(built):
    _, index, report = built
    assert [p for p, _ in rows(index.list_all_files(), "path", "id")] == ["crates/left/src/a.rs", "crates/left/src/b.rs", "crates/left/src/empty.rs", "crates/left/src/g.rs", "crates/left/src/lib.rs", "crates/right/src/lib.rs", "cs/Lib.cs", "cs/Use.cs"]
    assert report["errors"] == [("cs/Bad.cs", "not UTF-8")]


def test_each_arm_has_its_label(built):
    _, index, _ = built
    found = dict(rows(index.refs_named().where("kind in ('call', 'inherit') and strategy is not null"), "name", "strategy"))
    expected = {"named": "explicit_import", "starred": "glob_import", "made": "qualified_exact", "task": "qualified_module_fallback", "far": "unique_workspace", "own": "same_file", "Pick": "import_union", "Base": "import_union"}
    assert {n: found.get(n) for n in expected} == expected


def test_symbols(built):
    _, index, _ = built
    got = {q: (k, v, m, t) for q, k, v, m, t in rows(index.symbols.join(index.files.withColumnRenamed("id", "file_id").where("language = 'rust'"), "file_id"), "qualified_name", "kind", "visibility", "module_path", "is_test")}
    assert got["Held::made"] == ("method", "public", "crate::a", False)
    assert got["Held::0"] == ("struct_field", "private", "crate::a", False)
    assert got["checks"] == ("function", "private", "crate", True)


def test_graph(built):
    _, index, _ = built
    assert {q for (q,) in rows(index.get_callers("near"), "qualified_name")} == {"run", "starred", "task"}
    impact = dict(rows(index.get_symbol_impact("near"), "qualified_name", "depth"))
    assert impact["run"] == 1 and impact["checks"] == 2 and impact["back"] == 2
    assert rows(index.get_symbol_impact("near", 0), "id") == []
    chain = rows(index.get_dependency_chain("crates/left/src/lib.rs", "crates/right/src/lib.rs"), "path")
    assert chain == [("crates/left/src/lib.rs",), ("crates/right/src/lib.rs",)]
    cycles = rows(index.detect_cycles(), "paths")
    assert (["crates/left/src/g.rs", "crates/left/src/lib.rs"],) in cycles
    assert rows(index.get_type_hierarchy("Spare", "up"), "name", "depth") == [("Display", 1), ("Shape", 1)]
    assert rows(index.get_type_hierarchy("Base", "down"), "name", "depth") == [("User", 1)]


def test_analyses(built):
    _, index, _ = built
    assert {(n, t) for n, t in rows(index.find_dead_code(), "name", "tier")} == {("lonely", "definite"), ("twice", "definite")}
    assert rows(index.find_unused_imports(), "symbol_name", "confidence") == [("Spare", "definite")]
    assert rows(index.get_panic_points(), "kind", "qualified_name") == [("unwrap", "own")]
    assert rows(index.count_panic_points(), "production", "test") == [(1, 0)]
    assert rows(index.get_deprecated_symbols(), "name", "since", "note") == [("old", "2", "go away")]
    assert rows(index.get_deprecated_callers(), "tier", "via") == [("definite", "resolved")]
    untested, told = index.get_untested_code()
    assert told and {n for (n,) in rows(untested, "name")} == {"lonely", "twice", "back"}
    assert {n for (n,) in rows(index.get_affected_tests(["crates/left/src/b.rs"]), "name")} == {"checks"}
    coupling = {n: (a, e, i) for n, a, e, i in rows(index.get_coupling_metrics(), "name", "afferent", "efferent", "instability")}
    assert coupling == {"left-crate": (0, 1, 1.0), "right": (1, 0, 0.0)}


def test_unknown_names_are_errors(built):
    _, index, _ = built
    with pytest.raises(NotFound):
        index.get_callers("nothing")
    with pytest.raises(NotFound, match="right"):
        index.get_package_coupling("rihgt")


def test_standing_and_staleness(built):
    root, index, _ = built
    assert rows(index.get_stale_files(), "path", "status") == [("cs/Bad.cs", "added")]  # it is in no index
    (root / "cs/Bad.cs").unlink()
    assert not index.needs_update()
    tests, reasons = index.get_affected_tests_with_standing([])
    assert rows(tests, "id") == [] and rows(reasons, "reason") == []
    (root / "crates/left/src/new.rs").write_text("pub fn new() {}\n")
    (root / "crates/left/src/a.rs").write_text(FILES["crates/left/src/a.rs"] + "\n// more\n")
    assert rows(index.get_stale_files(), "path", "status") == [("crates/left/src/a.rs", "modified"), ("crates/left/src/new.rs", "added")]
    _, reasons = index.get_affected_tests_with_standing(["./crates/left/src/a.rs", "crates/left/src/new.rs", "crates/left/src/b.rs"])
    assert rows(reasons, "reason") == [("stale",), ("unindexed",), ("stale-index",)]
    (root / "crates/left/src/new.rs").unlink()


def test_command_line(built, spark, capsys):
    from quarry.cli import main

    root = str(built[0])
    assert main(["--root", root, "search", "near"], spark) == 0
    assert '"name":"near"' in capsys.readouterr().out
    assert main(["--root", root, "callers", "nothing"], spark) == 1
    assert main(["--root", root, "affected-tests", "missing.rs"], spark) == 2
