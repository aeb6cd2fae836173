"""Graph operators: frontier loops over edge tables, and simple cycles inside strong components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.runtime import settled

DEFAULT_DEPTH = 50
#: Edge tables of up to this many rows are walked in one task, which takes their size as a bound; larger ones hop by hop.
LOCAL_EDGES = 1_000_000
#: Tables of so many rounds of a walk are written as one, so that plans stay small.
ROUNDS_APART = 16


def reach(edges: DataFrame, src: str, dst: str, seeds: DataFrame, max_depth: int = DEFAULT_DEPTH, keep_seeds: bool = False) -> DataFrame:
    """(node, depth): nodes reached from the seeds (node), with their least number of hops, up to max_depth.

    Seeds are at depth 0 if keep_seeds is set and are then not found again; else a seed that an edge leads back
    to is listed like any other node. Each hop joins the frontier alone, which leaves out all nodes seen.
    """
    hops = edges.select(F.col(src).cast("long").alias("node"), F.col(dst).cast("long").alias("next")).where("node is not null and next is not null").distinct()
    hops = settled(hops, "hops")
    if hops.count() <= LOCAL_EDGES:
        return _reach_in_task(hops, seeds, max_depth, keep_seeds)
    frontier = settled(seeds.select("node", F.lit(0).alias("depth")).distinct(), "frontier")
    seen = frontier if keep_seeds else frontier.limit(0)
    for depth in range(1, max_depth + 1):
        found = frontier.select("node").join(hops, "node").select(F.col("next").alias("node")).distinct()
        frontier = settled(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _reach_in_task(hops: DataFrame, seeds: DataFrame, max_depth: int, keep_seeds: bool) -> DataFrame:
    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for a, b in zip(e["node"], e["next"], strict=True):
            out.setdefault(a, []).append(b)
        frontier = list(dict.fromkeys(s["node"]))
        seen = dict.fromkeys(frontier, 0) if keep_seeds else {}
        for depth in range(1, max_depth + 1):
            found = []
            for node in frontier:
                for to in out.get(node, ()):
                    if to not in seen:
                        seen[to] = depth
                        found.append(to)
            frontier = found
            if not found:
                break
        return pd.DataFrame({"node": list(seen), "depth": list(seen.values())})

    one = F.lit(0).alias("g")
    return hops.groupBy(one).cogroup(seeds.select(F.col("node").cast("long").alias("node")).distinct().groupBy(one)).applyInPandas(run, "node long, depth int")


def reachable(edges: DataFrame, src: str, dst: str, seeds: DataFrame) -> DataFrame:
    """(node): the seeds (node) and all nodes that they lead to, however far.

    Larger edge tables are cut into blocks of about LOCAL_EDGES edges by ranges of src. A round walks each block that
    new nodes lead into as far as its edges go, so the rounds grow with the changes of block along a path and not with
    its hops; a graph of long paths over scattered ids has many.
    """
    hops = edges.select(F.col(src).cast("long").alias("node"), F.col(dst).cast("long").alias("next")).where("node is not null and next is not null").distinct()
    hops = settled(hops, "hops")
    seeds = seeds.select(F.col("node").cast("long").alias("node")).where("node is not null").distinct()
    n = hops.count()
    if n <= LOCAL_EDGES:
        return _reach_in_task(hops, seeds, n, True).select("node")
    bounds = _bounds(hops, -(-n // max(1, LOCAL_EDGES)))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in parts:
            first, many = _homes(e["node"], bounds)
            yield e.assign(block=first + e["next"].to_numpy() % many)

    def entered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield _at_homes(s["node"].to_numpy(), bounds)

    def walk(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return _walk_block(int(key[0]), e, s, bounds)

    hops = settled(hops.mapInPandas(dealt, "node long, next long, block long"), "blocks", by="block")
    fresh = settled(seeds.mapInPandas(entered, "node long, block long"), "fresh")
    rounds: list[DataFrame] = []
    done = fresh.limit(0)
    while live := [r["block"] for r in fresh.select("block").distinct().collect()]:
        given = fresh.withColumn("fresh", F.lit(True)).unionByName(done.where(F.col("block").isin(live)).withColumn("fresh", F.lit(False)))
        found = settled(hops.where(F.col("block").isin(live)).groupBy("block").cogroup(given.groupBy("block")).applyInPandas(walk, "node long, block long, inside boolean"), "walked")
        rounds.append(found.where("inside").select("node", "block"))
        done = _union(rounds)
        if len(rounds) >= ROUNDS_APART:
            done = settled(done, "done")
            rounds = [done]
        fresh = settled(found.where("not inside").select("node", "block").distinct().join(done, ["node", "block"], "left_anti"), "fresh")
    return done.select("node").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _bounds(hops: DataFrame, blocks: int) -> np.ndarray:
    """The last node of each block but the last one; a node that stands there more than once has several blocks."""
    shares = [F.lit(i / blocks) for i in range(1, blocks)]
    found = hops.agg(F.percentile_approx("node", F.array(shares), max(10_000, 10 * blocks)).alias("b")).first()["b"] if shares else []
    return np.array(found, dtype="int64")


def _homes(nodes: pd.Series | np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each node and the number of its blocks, which follow each other."""
    first = np.searchsorted(bounds, nodes, "left")
    return first, np.maximum(np.searchsorted(bounds, nodes, "right") - first, 1)


def _at_homes(nodes: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    """(node, block): every block of every node."""
    first, many = _homes(nodes, bounds)
    at = np.repeat(np.arange(len(nodes)), many)
    return pd.DataFrame({"node": nodes[at], "block": first[at] + np.arange(len(at)) - (np.cumsum(many) - many)[at]})


def _walk_block(block: int, e: pd.DataFrame, s: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """(node, block, inside): what the fresh nodes of s (node, fresh) reach inside the block, and not yet inside where that leads to other blocks."""
    first, many = _homes(e["next"], bounds)
    here = (first <= block) & (block < first + many)
    out: dict = {}
    for a, b in zip(e["node"][here], e["next"][here], strict=True):
        out.setdefault(a, []).append(b)
    reached = list(s["node"][s["fresh"]])
    seen = set(s["node"])
    for node in reached:  # grows meanwhile
        for to in out.get(node, ()):
            if to not in seen:
                seen.add(to)
                reached.append(to)
    nodes = np.array(reached, dtype="int64")
    away = e[~here | (many > 1)]
    left = _at_homes(away["next"][away["node"].isin(nodes)].drop_duplicates().to_numpy(dtype="int64"), bounds)
    return pd.concat([pd.DataFrame({"node": nodes, "block": block, "inside": True}), left[left["block"] != block].assign(inside=False)])


def reach_paths(edges: DataFrame, src: str, dst: str, source: int, names: DataFrame, max_depth: int = DEFAULT_DEPTH, target: int | None = None) -> DataFrame:
    """(node, depth, path, rank): one shortest path to each node reached, the source left out.

    names: (node, name). Nodes are discovered in the order of their parents, and below one parent by name, then
    id; the parent of a node is the first that leads to it. With a target the search ends where it appears.
    """
    spark = edges.sparkSession
    hops = edges.select(F.col(src).cast("long").alias("node"), F.col(dst).cast("long").alias("next")).distinct()
    hops = settled(hops.join(names.select(F.col("node").alias("next"), "name"), "next", "left"), "hops")
    if hops.count() <= LOCAL_EDGES:
        return _paths_in_task(hops, source, max_depth, target)
    frontier = spark.createDataFrame([(source, 0, [source], 0)], "node long, depth int, path array<long>, rank long")
    seen = frontier
    for depth in range(1, max_depth + 1):
        found = frontier.join(hops, "node").join(seen.select(F.col("node").alias("next")), "next", "left_anti")
        first = found.groupBy("next").agg(F.min_by(F.struct("path", "name", "rank"), "rank").alias("p"))
        order = Window.orderBy("p.rank", "p.name", "next")  # one hop's nodes: their order is the result
        first = first.withColumn("place", F.row_number().over(order).cast("long"))
        frontier = settled(first.select(F.col("next").alias("node"), F.lit(depth).alias("depth"), F.concat("p.path", F.array("next")).alias("path"), F.col("place").alias("rank")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    return seen.where(F.col("depth") > 0)


def _paths_in_task(hops: DataFrame, source: int, max_depth: int, target: int | None) -> DataFrame:
    def run(e: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for name, a, b in sorted(zip(e["name"].fillna(""), e["node"], e["next"], strict=True)):
            out.setdefault(a, []).append(b)
        paths, frontier, rows = {source: [source]}, [source], []
        for depth in range(1, max_depth + 1):
            found = []
            for node in frontier:
                for to in out.get(node, ()):
                    if to not in paths:
                        paths[to] = [*paths[node], to]
                        found.append(to)
                        rows.append((to, depth, paths[to], len(found)))
            frontier = found
            if not found or target in paths:
                break
        return pd.DataFrame(rows, columns=["node", "depth", "path", "rank"])

    return hops.groupBy(F.lit(0).alias("g")).applyInPandas(run, "node long, depth int, path array<long>, rank long")


def dependency_chain(edges: DataFrame, src: str, dst: str, source: int, target: int, names: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(position, node) of a shortest chain, both ends included; one row if they are equal, none if there is no chain."""
    if source == target:
        return edges.sparkSession.createDataFrame([(0, source)], "position int, node long")
    found = reach_paths(edges, src, dst, source, names, max_depth, target).where(F.col("node") == target)
    return found.select(F.posexplode("path").alias("position", "node"))


def trimmed(edges: DataFrame, most: int = 100) -> DataFrame:
    """Edges without those that cannot lie on a cycle: nodes without a way in or out are dropped until none is left."""
    e = settled(edges, "edges")
    before = e.count()
    for _ in range(most):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = settled(e, "edges")
        now = e.count()
        if now == before:
            break
        before = now
    return e


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, root) by label propagation with pointer jumping; every node of an edge is listed."""
    both = settled(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = settled(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("near"))
        new = labels.join(near, labels["node"] == near["src"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        new = settled(new, "labels")
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = settled(new.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was"), "labels")
        if new.where("root != was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _strong(nodes: list, out: dict) -> list[list]:
    """Strong components by Tarjan's walk, without recursion."""
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    found = []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(out.get(to, ()))))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    found.append(part)
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc, size): the strong components of more than one node, or of a node with an edge to itself.

    Edges that lie on no cycle are trimmed first; what is left falls into weak components, each of which is one
    group's work. scc is the least node.
    """
    e = settled(edges.select("src", "dst").distinct(), "edges")
    if e.count() <= LOCAL_EDGES:
        grouped = e.withColumn("root", F.lit(0))
    else:
        e = trimmed(e)
        grouped = e.join(weak_components(e).withColumnRenamed("node", "src"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            out.setdefault(a, []).append(b)
        rows = [(n, min(p), len(p)) for p in _strong(sorted(set(pdf["src"]) | set(pdf["dst"])), out) if len(p) > 1 or p[0] in out.get(p[0], ()) for n in p]
        return pd.DataFrame(rows, columns=["node", "scc", "size"])

    return grouped.groupBy("root").applyInPandas(run, "node long, scc long, size long")


def simple_cycles(nodes: list, out: dict) -> Iterator[list]:
    """All simple cycles of a graph, each from its least node in the order of `nodes`, which must be sorted.

    From each start, the strong component of it among the nodes not below it is walked; a node stays blocked
    until some cycle through it can have become possible again.
    """
    rank = {n: i for i, n in enumerate(nodes)}
    for start in nodes:
        live = [n for n in nodes if rank[n] >= rank[start]]
        inside = {n: [t for t in out.get(n, ()) if rank[t] >= rank[start]] for n in live}
        part = next((set(p) for p in _strong([start], inside) if start in p), {start})
        near = {n: [t for t in inside[n] if t in part] for n in part}
        blocked, waiting = {start}, {n: set() for n in part}
        path, work = [start], [(start, iter(near[start]), [False])]
        while work:
            node, rest, closed = work[-1]
            for to in rest:
                if to == start:
                    yield list(path)
                    closed[0] = True
                elif to not in blocked:
                    path.append(to)
                    blocked.add(to)
                    work.append((to, iter(near[to]), [False]))
                    break
            else:
                work.pop()
                path.pop()
                if closed[0]:
                    free = [node]
                    while free:
                        n = free.pop()
                        if n in blocked:
                            blocked.discard(n)
                            free += waiting[n]
                            waiting[n].clear()
                    if work:
                        work[-1][2][0] = True
                else:
                    for to in near[node]:
                        waiting[to].add(node)


def detect_cycles(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(ids, paths, length): every simple directed cycle of file dependencies, self-loops included.

    A cycle starts at its least path; paths compare part by part, as in split(path, '/'). An edge to a file that is
    not there is an error.
    """
    e = settled(deps.select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst")).distinct(), "deps")
    known = files.select(F.col("id").alias("dst"))
    lost = e.join(known, "dst", "left_anti").unionByName(e.join(known.withColumnRenamed("dst", "src"), "src", "left_anti"))
    if not lost.isEmpty():
        raise ValueError(f"a file dependency has an unknown end: {lost.first().asDict()}")
    parts = strong_components(e)
    inner = e.join(parts.select(F.col("node").alias("src"), "scc"), "src").join(parts.select(F.col("node").alias("dst"), F.col("scc").alias("scc2")), "dst").where("scc = scc2")
    a = files.select(F.col("id").alias("src"), F.col("path").alias("src_path"))
    b = files.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
    inner = inner.join(a, "src").join(b, "dst").select("scc", "src", "dst", "src_path", "dst_path")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = dict(zip(pdf["src"], pdf["src_path"], strict=True)) | dict(zip(pdf["dst"], pdf["dst_path"], strict=True))
        nodes = sorted(path, key=lambda n: path[n].split("/"))
        rank = {n: i for i, n in enumerate(nodes)}
        out: dict = {}
        for s, t in zip(pdf["src"], pdf["dst"], strict=True):
            out.setdefault(s, []).append(t)
        for s in out:
            out[s].sort(key=rank.__getitem__)
        rows = [(c, [path[n] for n in c]) for c in simple_cycles(nodes, out)]
        return pd.DataFrame({"ids": [r[0] for r in rows], "paths": [r[1] for r in rows]})

    return inner.groupBy("scc").applyInPandas(run, "ids array<long>, paths array<string>").withColumn("length", F.size("paths"))


def ordered_cycles(found: DataFrame) -> DataFrame:
    """detect_cycles() with cycle, the place of each in the order of their paths, by ranges of these and not in one task."""
    from quarry.extract.stage import numbered

    rows = found.withColumn("key", F.transform("paths", lambda p: F.split(p, "/")))
    return numbered(rows, "key").withColumn("cycle", F.col("id").cast("int")).drop("key", "id")


def type_hierarchy(name: str, direction: str, refs: DataFrame, symbols: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(symbol_id, name, depth): supertypes (up) or subtypes (down) of every container of a name.

    An inherit reference leads from the symbol that it stands in to its symbol. Going up, unresolved names are
    leaves, once for each name; going down, only containers count.
    """
    from quarry.schema import CONTAINERS

    kinds = symbols.where(F.col("kind").isin(CONTAINERS)).select("id")
    roots = symbols.where((F.col("name") == name) & F.col("kind").isin(CONTAINERS)).select(F.col("id").alias("node"))
    inherit = refs.where("kind = 'inherit' and in_symbol_id is not null").select(F.col("in_symbol_id").alias("sub"), F.col("symbol_id").alias("super"), "reference_name")
    inherit = inherit.join(kinds.withColumnRenamed("id", "sub"), "sub", "left_semi")
    if direction == "up":
        found = settled(reach(inherit, "sub", "super", roots, max_depth, keep_seeds=True), "up")
        leaves = inherit.where("super is null and reference_name is not null").join(found.where(F.col("depth") < max_depth), F.col("sub") == F.col("node"))
        leaves = leaves.groupBy("reference_name").agg((F.min("depth") + 1).alias("depth")).select(F.lit(None).cast("long").alias("symbol_id"), F.col("reference_name").alias("name"), "depth")
        known = found.where("depth > 0").join(symbols.select(F.col("id").alias("node"), "name"), "node").select(F.col("node").alias("symbol_id"), "name", "depth")
        return known.unionByName(leaves)
    found = reach(inherit, "super", "sub", roots, max_depth, keep_seeds=True).where("depth > 0")
    return found.join(symbols.select(F.col("id").alias("node"), "name"), "node").select(F.col("node").alias("symbol_id"), "name", "depth")
