"""Command line: one subcommand for each query; results as JSON lines, as one JSON document (--json) or as text (--text)."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession

from quarry.api import Index, NotFound


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--root", default=".")
    p.add_argument("--lsp", help="command line of a language server, for index, callers and references that the index cannot bind")
    p.add_argument("--lsp-timeout", type=float, default=60.0)
    form = p.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true")
    form.add_argument("--text", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for names, options in args:
            c.add_argument(*names, **options)

    flag = {"action": "store_true"}
    command("index", (["--rebuild"], flag), (["--update"], flag), (["--purge"], flag), (["--language"], {"action": "append"}))
    command("search", (["query"], {}), (["-k", "--kind"], {}), (["-l", "--limit"], {"type": int, "default": 20}))
    command("callers", (["symbol"], {}), (["-t", "--transitive"], flag), (["-d", "--depth"], {"type": int, "default": 50}), (["--exclude-speculative"], flag))
    command("impact", (["target"], {}), (["-s", "--symbol"], flag), (["-d", "--depth"], {"type": int, "default": 50}))
    command("coupling", (["--sort"], {"choices": ["instability", "afferent", "efferent", "name"], "default": "instability"}), (["--package"], {}))
    command("cycles")
    command("stats")
    command("reachable", (["symbol"], {}), (["-d", "--direction"], {"choices": ["forward", "backward"], "default": "forward"}), (["-n", "--max-depth"], {"type": int, "default": 10}))
    command("affected-tests", (["files"], {"nargs": "*"}), (["--names-only"], flag))
    command("panic-points", (["--include-tests"], flag), (["--file"], {}))
    command("deprecated-callers")
    command("visibility-tightening", (["--workspace-closed"], flag))
    command("unused-imports", (["--all"], flag))
    command("untested-code")
    command("dead-code", (["--limit"], {"type": int}))
    command("hierarchy", (["name"], {}), (["--direction"], {"choices": ["up", "down"], "default": "up"}))
    return p


def plain(value) -> str:
    """A cell of a text table."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:.2f}"
    return " -> ".join(map(plain, value)) if isinstance(value, list) else str(value)


def text_lines(rows: list[dict]) -> list[str]:
    """A table with a heading; rows that have a depth stand below one line for each depth."""
    if not rows:
        return ["nothing found"]
    names = [n for n in rows[0] if n != "depth"]
    width = {n: max(len(n), *(len(plain(r[n])) for r in rows)) for n in names}
    out, depth = ["  ".join(n.ljust(width[n]) for n in names).rstrip()], None
    for r in rows:
        if r.get("depth", depth) != depth:
            depth = r["depth"]
            out.append(f"depth {depth}")
        out.append("  ".join(plain(r[n]).ljust(width[n]) for n in names).rstrip())
    return out


def render(df: DataFrame, form: str = "lines") -> None:
    """Rows as they come, one JSON object a line; the other two forms are made of all rows at once, for answers that a person reads."""
    if form == "lines":
        for line in df.toJSON().toLocalIterator():
            print(line)
        return
    rows = [{n: r.get(n) for n in df.columns} for r in map(json.loads, df.toJSON().toLocalIterator())]
    print(json.dumps(rows, indent=2, ensure_ascii=False) if form == "json" else "\n".join(text_lines(rows)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: an error; 2: an answer about affected tests or untested code that the index cannot vouch for."""
    a = parser().parse_args(argv)
    index = Index(spark or SparkSession.builder.appName("quarry").getOrCreate(), a.root)
    try:
        return run(index, a)
    except (NotFound, RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(index: Index, a: argparse.Namespace) -> int:
    form = "json" if a.json else "text" if a.text else "lines"

    def show(df: DataFrame) -> None:
        render(df, form)

    server = shlex.split(a.lsp) if a.lsp else None
    match a.command:
        case "index":
            if a.purge:
                print({"purged": index.purge_orphan_files()})
                return 0
            report = index.update() if a.update else index.rebuild(a.language) if a.rebuild else index.index(a.language)
            if server:
                report = index.with_lsp(index.ask_server(server, timeout=a.lsp_timeout)).index(a.language)
            print(json.dumps(report) if a.json else report)
        case "search":
            show(index.search_symbols(a.query, 100, a.kind).limit(a.limit))
        case "callers":
            if server and not (a.transitive or a.exclude_speculative):
                show(index.get_lsp_callers(a.symbol, server, a.lsp_timeout))
            else:
                show(index.get_symbol_impact(a.symbol, a.depth, a.exclude_speculative) if a.transitive else index.get_callers(a.symbol, a.exclude_speculative))
        case "impact":
            show(index.get_symbol_impact(a.target, a.depth) if a.symbol else index.get_impact(a.target, a.depth))
        case "coupling":
            show(index.get_package_coupling(a.package) if a.package else index.get_coupling_metrics(a.sort))
        case "cycles":
            show(index.detect_cycles())
        case "stats":
            show(index.get_stats())
        case "reachable":
            show(index.get_reachable(a.symbol, a.direction, a.max_depth))
        case "affected-tests":
            tests, reasons = index.get_affected_tests_with_standing(a.files)
            show(tests.select("qualified_name") if a.names_only else tests)
            doubts = reasons.collect()
            for r in doubts:
                print(f"indeterminate: {r['reason']} {r['path'] or ''}".rstrip(), file=sys.stderr)
            return 2 if doubts else 0
        case "panic-points":
            show(index.get_panic_points(a.include_tests, a.file))
        case "deprecated-callers":
            show(index.get_deprecated_callers())
        case "visibility-tightening":
            show(index.get_visibility_candidates(a.workspace_closed))
        case "unused-imports":
            show(index.find_unused_imports(a.all))
        case "untested-code":
            found, told = index.get_untested_code()
            show(found)
            return 0 if told else 2
        case "dead-code":
            show(index.find_dead_code(a.limit))
            if a.limit is not None:
                tiers = index.dead_code_summary()
                print(f"{tiers['definite']} definite, {tiers['maybe']} maybe; at most {a.limit} shown", file=sys.stderr)
        case "hierarchy":
            show(index.get_type_hierarchy(a.name, a.direction))
    return 0


if __name__ == "__main__":
    sys.exit(main())
