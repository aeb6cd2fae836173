"""Updates after files have come, changed and gone; deletion and purge; a language server over pipes."""

import sys

import pytest

from quarry.api import Index

FILES = {
    "Cargo.toml": '[package]\nname = "one"\n',
    "src/lib.rs": "pub mod a;\npub mod b;\npub fn top() { a::low(); b::deep(); late(); }\n",
    "src/a.rs": "pub fn low() {}\n",
    "src/b.rs": "pub fn deep() { crate::a::low(); }\n",
    "tools/loose.rs": "fn alone() {}\n",
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.fixture
def work(spark, tmp_path):
    write(tmp_path, FILES)
    index = Index(spark, str(tmp_path))
    index.index()
    return tmp_path, index


def whole(index):
    """What an index says, without its ids."""
    names = {r["id"]: r["qualified_name"] for r in index.symbols.collect()}
    paths = {r["id"]: r["path"] for r in index.files.collect()}
    return {
        "files": sorted(paths.values()),
        "symbols": sorted(names.values()),
        "refs": sorted((paths[r["file_id"]], r["kind"], r["line"], names.get(r["symbol_id"]) or "", r["reference_name"] or "", r["strategy"] or "") for r in index.refs.collect()),
        "calls": sorted((names[r["caller_symbol_id"]], names[r["callee_symbol_id"]], r["call_count"]) for r in index.call_edges.collect()),
        "deps": sorted((paths[r["from_file_id"]], paths[r["to_file_id"]], r["ref_count"]) for r in index.file_deps.collect()),
    }


def test_an_update_equals_a_new_index(work, spark, tmp_path_factory):
    root, index = work
    assert index.update() == {}
    write(root, {"src/a.rs": "pub fn low2() {}\npub fn late() {}\n", "src/c.rs": "pub fn fresh() { crate::top(); }\n"})
    (root / "src/b.rs").unlink()
    report = index.update()
    assert report["files"] == 4 and report["errors"] == []
    fresh = Index(spark, str(root), str(tmp_path_factory.mktemp("other") / "index"))
    fresh.index()
    assert whole(index) == whole(fresh)
    assert ("top", "late", 1) in whole(index)["calls"] and "deep" not in whole(index)["symbols"]
    assert not index.needs_update()


def test_only_changed_files_are_extracted(work, monkeypatch):
    """Files whose extraction would now fail keep what they held."""
    root, index = work
    write(root, {"src/a.rs": "pub fn low() {}\npub fn more() {}\n"})
    held = index.tables["extracted"].where("path != 'src/a.rs'").select("path", "symbols").collect()
    index.update()
    assert sorted(index.tables["extracted"].where("path != 'src/a.rs'").select("path", "symbols").collect()) == sorted(held)
    assert "more" in whole(index)["symbols"]


def test_deleting_and_purging(work):
    root, index = work
    assert index.delete_files(["src/b.rs", "missing.rs"]) == 1
    got = whole(index)
    assert "src/b.rs" not in got["files"] and not any("deep" in c for c in got["calls"]) and not any("src/b.rs" in d for d in got["deps"])
    (root / "src/a.rs").unlink()
    assert index.purge_orphan_files() == 1 and index.purge_orphan_files() == 0
    got = whole(index)
    assert got["files"] == ["src/lib.rs", "tools/loose.rs"] and got["calls"] == [] and got["deps"] == []
    assert index.get_file_id("src/lib.rs") is not None and index.get_file_id("src/a.rs") is None
    ids = [r["id"] for r in index.files.collect()]
    assert [r["path"] for r in index.get_files_by_ids(ids).collect()] == got["files"]


def test_an_index_from_a_stream_equals_one_at_once(work, spark, tmp_path_factory):
    root, index = work
    side = tmp_path_factory.mktemp("stream")
    streamed = Index(spark, str(root), str(side / "index"))
    assert streamed.index_stream(str(side / "table"), str(side / "marks"), 2)["files"] == 4
    assert whole(streamed) == whole(index)
    write(root, {"src/d.rs": "pub fn more() { crate::top(); }\n"})
    (root / "src/b.rs").unlink()
    assert streamed.index_stream(str(side / "table"), str(side / "marks"), 2)["files"] == 4
    index.update()
    assert whole(streamed) == whole(index)


SERVER = '''
import json, sys, os
root = os.getcwd()
def send(m):
    b = json.dumps({"jsonrpc": "2.0"} | m).encode()
    sys.stdout.buffer.write(b"Content-Length: %d\\r\\n\\r\\n" % len(b) + b)
    sys.stdout.buffer.flush()
while True:
    size = 0
    while (line := sys.stdin.buffer.readline().strip()):
        size = int(line.split(b":")[1])
    if not size:
        break
    m = json.loads(sys.stdin.buffer.read(size))
    if m.get("method") == "exit":
        break
    if m.get("method") == "initialized":
        send({"id": "q", "method": "window/workDoneProgress/create", "params": {"token": "t"}})
        send({"method": "$/progress", "params": {"token": "t", "value": {"kind": "begin", "title": "x"}}})
        send({"method": "$/progress", "params": {"token": "t", "value": {"kind": "end"}}})
    if "id" not in m or "method" not in m:
        continue
    result = None
    if m["method"] == "initialize":
        result = {"capabilities": {"positionEncoding": "utf-16"}}
    uri = "file://" + root + "/src/b.rs"
    where = {"start": {"line": 0, "character": 7}, "end": {"line": 0, "character": 11}}
    if m["method"] == "textDocument/definition":
        at = m["params"]["position"]
        text = open(root + m["params"]["textDocument"]["uri"].split(root)[1]).read().split("\\n")[at["line"]]
        word = text.encode("utf-16-le")[2 * at["character"]:].decode("utf-16-le")
        if word.startswith("late"):
            result = [{"targetUri": uri, "targetSelectionRange": where, "targetRange": where}]
        elif word.startswith("bad"):
            send({"id": m["id"], "error": {"code": 1, "message": "no"}})
            continue
    if m["method"] == "textDocument/references":
        result = [{"uri": "file://" + root + "/src/lib.rs", "range": {"start": {"line": 2, "character": 0}, "end": {"line": 2, "character": 1}}}, {"uri": "file:///elsewhere/x.rs", "range": where}]
    send({"id": m["id"], "result": result})
'''


def test_a_language_server_binds_what_is_left(spark, tmp_path, capsys):
    write(tmp_path, FILES | {"src/lib.rs": "pub mod a;\npub mod b;\npub fn top() { /* \U0001f600 */ late(); bad(); }\n"})
    (tmp_path / "server.py").write_text(SERVER)
    command = [sys.executable, str(tmp_path / "server.py")]
    index = Index(spark, str(tmp_path))
    index.index()
    answers = index.ask_server(command, timeout=20.0)
    assert [(r["ref_path"], r["def_path"], r["def_line"]) for r in answers.collect()] == [("src/lib.rs", "src/b.rs", 1)]
    index.with_lsp(answers).index()
    again = Index(spark, str(tmp_path))
    assert [(r["name"], r["strategy"]) for r in again.refs_named().where("strategy = 'lsp'").collect()] == [("deep", "lsp")]
    assert {(r["name"], r["source"]) for r in again.get_lsp_callers("low", command, 20.0).collect()} == {("deep", "indexed"), ("top", "lsp")}
    from quarry.cli import main

    assert main(["--root", str(tmp_path), "--json", "--lsp", " ".join(command), "callers", "low"], spark) == 0
    assert {r["name"] for r in __import__("json").loads(capsys.readouterr().out)} == {"deep", "top"}
    assert main(["--root", str(tmp_path), "--text", "impact", "-s", "low"], spark) == 0
    assert "depth 1" in capsys.readouterr().out
    assert main(["--root", str(tmp_path), "--lsp", "/no/such/server", "callers", "low"], spark) == 1
