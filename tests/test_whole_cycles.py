"""Cycles and strong components over all file dependencies, against a plain search."""

import os

import pytest

from quarry.plans.queries import QUERIES

DATA = os.environ.get("QUARRY_DATA", "/root/testdata/sf0.001")


def _plain_cycles(out):
    found = []

    def walk(start, path):
        for to in out.get(path[-1], ()):
            if to == start:
                found.append((",".join(sorted(map(str, path))), len(path)))
            elif to > start and to not in path:
                walk(start, [*path, to])

    for start in out:
        walk(start, [start])
    return found


def _reached(out, start):
    seen, work = set(), [start]
    while work:
        for to in out.get(work.pop(), ()):
            if to not in seen:
                seen.add(to)
                work.append(to)
    return seen


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_no_dependency_is_left_out(spark):
    out = {}
    for r in QUERIES["file_deps"](spark, DATA).collect():
        out.setdefault(r["from_file_id"], set()).add(r["to_file_id"])
    reach = {n: _reached(out, n) for n in out}
    parts = {n: {m for m in reach[n] if n in reach.get(m, ())} for n in out if n in reach[n]}
    assert max(map(len, parts.values())) > 4
    assert {tuple(r) for r in QUERIES["scc"](spark, DATA).select("node", "scc", "size").collect()} == {(n, min(p), len(p)) for n, p in parts.items()}
    assert sorted(tuple(r) for r in QUERIES["cycles"](spark, DATA).select("members", "length").collect()) == sorted(_plain_cycles(out))
