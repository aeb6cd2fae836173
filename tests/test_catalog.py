"""The index on disk: versions, cascades, compaction; a language server's answers as rows."""

import pytest

from quarry.api import Index
from quarry.sources import catalog

FILES = {
    "Cargo.toml": '[package]\nname = "one"\n',
    "src/lib.rs": "pub mod a;\npub fn top() { a::low(); mystery(); }\n",
    "src/a.rs": "pub fn low() {}\n",
    "src/b.rs": "pub fn hidden() {}\npub fn same() {}\n",
    "src/c.rs": "pub fn same() {}\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    for path, text in FILES.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    out = Index(spark, str(root))
    out.index()
    return out


def test_deleting_files_cascades(index):
    gone = index.files.where("path = 'src/a.rs'").selectExpr("id as file_id")
    left = catalog.without_files(index.tables, gone)
    assert index.call_edges.count() == 1 and index.file_deps.count() == 1
    assert sorted(r["name"] for r in left["symbols"].collect()) == ["a", "hidden", "same", "same", "top"]
    assert [r["reference_name"] for r in left["refs"].collect()] == ["mystery"]
    assert left["call_edges"].count() == 0 and left["file_deps"].count() == 0 and left["file_packages"].count() == 3


def test_vacuum_keeps_all_rows(index):
    before = {n: df.count() for n, df in index.tables.items()}
    index.vacuum()
    assert {n: df.count() for n, df in index.tables.items()} == before


def test_server_answers_bind_what_is_left(index, spark):
    answers = spark.createDataFrame([("src/lib.rs", 2, 26, "src/b.rs", 1)], "ref_path string, ref_line int, ref_column int, def_path string, def_line int")
    refined = index.with_lsp(answers)
    refined.index()
    assert [(r["name"], r["strategy"]) for r in refined.refs_named().where("strategy = 'lsp'").collect()] == [("hidden", "lsp")]
    sites = refined.files.where("path = 'src/lib.rs'").selectExpr("id as file_id", "2 as line")
    assert [(r["name"], r["source"]) for r in refined.get_callers("same", sites=sites).collect()] == [("top", "lsp")]


def test_readers_see_whole_generations(index, spark):
    """A generation whose marker is missing does not count; vacuum leaves one."""
    import os

    before = index.symbols.count()
    for name, df in index.tables.items():
        df.limit(0).write.parquet(f"{index.folder}/half/{name}")
    assert Index(spark, index.root).symbols.count() == before
    index.index()
    index.vacuum()
    assert len([d for d in os.listdir(f"{index.folder}/marks") if d.startswith("n=")]) == 1
    assert Index(spark, index.root).symbols.count() == before


def test_analyze(index):
    rows = {(r["relation"], r["column"]): r for r in index.analyze().where("relation = 'files'").collect()}
    assert rows["files", "path"]["rows"] == rows["files", "path"]["distinct"] == index.files.count() and rows["files", "content_hash"]["nulls"] == index.files.count()


def test_other_versions_are_refused(index, spark):
    spark.createDataFrame([(0, "x")], "version int, at string").coalesce(1).write.json(f"{index.folder}/marks/n=999")
    with pytest.raises(catalog.OutdatedIndex, match="rebuild"):
        Index(spark, index.root).files  # noqa: B018
