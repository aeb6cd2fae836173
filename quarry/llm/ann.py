"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import drop_kept, kept, tune


@dataclass(frozen=True)
class Settings:
    """sample: rows on which the tree's upper part is fitted, about; branch: children of a node; leaf: sampled rows from which a
    node is split; heavy: rows from which a leaf is split again, on a sample of its own of about `again` rows; most: leaves at
    most, which bounds the tree that is broadcast; recall: what a calibration sample of `trial` queries must reach, against
    brute force; rows: vectors of one block."""

    sample: int = 20_000
    branch: int = 8
    leaf: int = 400
    heavy: int = 2000
    again: int = 2000
    most: int = 1 << 16
    recall: float = 0.95
    trial: int = 100
    rows: int = 2048


class Tree:
    """Nodes with a centre and a radius each; children are adjacent. Leaves are numbered in order."""

    def __init__(self, x: np.ndarray, branch: int, leaf: int):
        rng = np.random.default_rng(11)
        centres, children = [x.mean(0) if len(x) else np.zeros(0)], [(0, 0)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf or len(np.unique(x[rows], axis=0)) <= branch:
                continue
            c, own = self._kmeans(x[rows], branch, rng)
            first = len(centres)
            centres += list(c)
            children += [(0, 0)] * len(c)
            children[node] = (first, first + len(c))
            todo += [(first + k, rows[own == k]) for k in range(len(c))]
        self.centres, self.children = np.array(centres), children
        self._number()

    def _number(self) -> None:
        self.leaf_of = np.full(len(self.children), -1)
        ends = [n for n, (a, b) in enumerate(self.children) if a == b]
        self.leaf_of[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def graft(self, parts: dict[int, tuple[np.ndarray, list[tuple[int, int]]]]) -> None:
        """Put (centres, children) of other trees, whose roots are left out, in the place of leaves."""
        node_of = np.flatnonzero(self.leaf_of >= 0)
        centres = [self.centres]
        for leaf, (more, children) in sorted(parts.items()):
            by = len(self.children) - 1
            self.children[node_of[leaf]] = (children[0][0] + by, children[0][1] + by)
            self.children += [(a + by, b + by) if a < b else (0, 0) for a, b in children[1:]]
            centres.append(more[1:])
        self.centres = np.concatenate(centres)
        self._number()

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            own = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
            c = np.stack([x[own == j].mean(0) if (own == j).any() else x[rng.integers(len(x))] for j in range(k)])
        own = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        live = np.unique(own)
        return c[live], np.searchsorted(live, own)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at each node."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, b = self.children[node]
            if a == b:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centres[a:b]
            own = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(a + k, r) for k in range(b - a) if len(r := rows[own == k])]
        return out

    def best_first(self, q: np.ndarray, radius: np.ndarray) -> Iterator[int]:
        """Leaves by falling bound of the inner product, q . centre + |q| radius, through a priority queue."""
        size = float(np.sqrt(q @ q))
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            a, b = self.children[node]
            if a == b:
                yield int(self.leaf_of[node])
                continue
            bound = self.centres[a:b] @ q + size * radius[a:b]
            for k in range(a, b):
                if radius[k] >= 0:
                    heapq.heappush(heap, (-float(bound[k - a]), k))

    def radii(self, leaf_radius: np.ndarray) -> np.ndarray:
        """For nodes; leaf_radius has -1 for empty leaves. An inner node spans its children's balls, and is empty if they are."""
        out = np.full(len(self.children), -1.0)
        for node in range(len(self.children) - 1, -1, -1):
            a, b = self.children[node]
            if a == b:
                out[node] = leaf_radius[self.leaf_of[node]]
            elif (out[a:b] >= 0).any():
                live = a + np.flatnonzero(out[a:b] >= 0)
                out[node] = (np.linalg.norm(self.centres[live] - self.centres[node], axis=1) + out[live]).max()
        return out


def exact_top(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, id, score) of each query's k largest inner products, ties to the smaller id, without its own id.

    A product of matrices picks all rows that could count; their scores are then summed one component after
    another in double precision, so equal vectors have equal scores wherever they stand.
    """
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], q_ids[at : at + 256]
        rough = q @ x.T
        slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0))
        want = min(k + int(pd.Series(ids).value_counts().max()), len(x))  # a query's own id may be among them
        least = np.partition(rough, len(x) - want, axis=1)[:, len(x) - want]
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & (ids[None, :] != own[:, None]))
        score = np.zeros(len(i))
        for d in range(x.shape[1]):
            score += q[i, d] * x[j, d]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        yield i[top] + at, ids[j[top]], score[top]


def _matrix(column) -> np.ndarray:
    values = column.to_numpy() if isinstance(column, pd.Series) else column
    return np.array([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def _search(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each block of a leaf that it visits, without those below its bound."""

    def run(_, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, own = x["vec_id"].to_numpy(), q["query_id"].to_numpy()
        found = list(exact_top(_matrix(q["vector"]), own, _matrix(x["vector"]), ids, k))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        near = s >= q["bound"].to_numpy()[i]
        i, j, s = i[near], j[near], s[near]
        return pd.DataFrame({"query_id": own[i], "vec_id": j, "score": s})

    return pairs.groupBy("leaf", "block").cogroup(blocks.groupBy("leaf", "block")).applyInPandas(run, "query_id long, vec_id long, score double")


def _brute(trial: list[tuple[int, np.ndarray]], rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of a bounded list of queries in each batch of all rows."""
    shipped = rows.sparkSession.sparkContext.broadcast((np.array([t[0] for t in trial]), np.stack([t[1] for t in trial])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = shipped.value
        for x in batches:
            if len(x):
                for i, j, s in exact_top(q, own, _matrix(x["vector"]), x["vec_id"].to_numpy(), k):
                    yield pd.DataFrame({"query_id": own[i], "vec_id": j, "score": s})

    return rows.select("vec_id", "vector").mapInPandas(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _assigned(rows: DataFrame, tree: Tree) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Each row with its leaf; rows and radius (-1: empty) of each leaf."""
    shipped = rows.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shipped.value
        centres = tree.centres[tree.leaf_of >= 0]
        for batch in batches:
            if len(batch):
                x = _matrix(batch["vector"])
                leaf = tree.assign(x)
                yield batch.assign(leaf=leaf, away=np.linalg.norm(x - centres[leaf], axis=1))

    rows = kept(rows.mapInPandas(assign, "vec_id long, vector array<double>, leaf long, away double"), "ann-leaves")
    held, radius = np.zeros(tree.leaves, dtype=np.int64), np.full(tree.leaves, -1.0)
    for r in rows.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        held[r["leaf"]], radius[r["leaf"]] = r["n"], r["r"]
    return rows, held, radius


def _split_heavy(rows: DataFrame, tree: Tree, held: np.ndarray, settings: Settings) -> bool:
    """Fit a tree to a bounded sample of each leaf that holds too many rows, a task each, and graft it; whether any leaf was split."""
    heavy = np.flatnonzero(held > settings.heavy)
    heavy = heavy[np.argsort(-held[heavy])][: max(0, settings.most - tree.leaves) // settings.branch]
    if not len(heavy):
        return False
    share = np.zeros(tree.leaves)
    share[heavy] = np.minimum(1.0, settings.again / held[heavy])
    of = rows.sparkSession.sparkContext.broadcast(held)
    drawn = F.pmod(F.xxhash64("vec_id", "vector", F.lit("again")), F.lit(1_000_000)) < F.element_at(F.lit(share).cast("array<double>"), (F.col("leaf") + 1).cast("int")) * 1_000_000

    def fit(key, x: pd.DataFrame) -> pd.DataFrame:
        n = int(of.value[key[0]])
        tree = Tree(_matrix(x.sort_values("vec_id")["vector"]), settings.branch, max(settings.branch, settings.heavy * min(settings.again, n) // (2 * n)))
        if tree.leaves < 2:
            return pd.DataFrame({"leaf": [], "centres": [], "first": [], "last": []})
        return pd.DataFrame({"leaf": [key[0]], "centres": [tree.centres.ravel()], "first": [[a for a, _ in tree.children]], "last": [[b for _, b in tree.children]]})

    fitted = rows.where(drawn).groupBy("leaf").applyInPandas(fit, "leaf long, centres array<double>, first array<int>, last array<int>")
    parts, room = {}, settings.most - tree.leaves
    for r in fitted.orderBy("leaf").toLocalIterator():
        children = list(zip(r["first"], r["last"], strict=True))
        room -= sum(a == b for a, b in children)
        if room >= 0:
            parts[r["leaf"]] = (np.array(r["centres"]).reshape(len(children), -1), children)
    tree.graft(parts)
    return bool(parts)


def fit_index(rows: DataFrame, asked: DataFrame, k: int, settings: Settings) -> tuple | None:
    """(tree, radii, rows of each leaf, leaves that a query visits, sample, its ids, rows with their leaf, queries) for rows (vec_id, vector)."""
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("vector") == d)
    asked = asked.where(F.size("vector") == d).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < min(1.0, settings.sample / n) * 1_000_000
    taken = [(r["vec_id"], r["vector"]) for r in rows.where(drawn).orderBy("vec_id", "vector").toLocalIterator()] or [(r["vec_id"], r["vector"]) for r in rows.limit(1).collect()]
    sample, sample_ids = _matrix([t[1] for t in taken]), np.array([t[0] for t in taken])
    tree = Tree(sample, settings.branch, settings.leaf)
    rows, held, radius = _assigned(rows, tree)
    while _split_heavy(rows, tree, held, settings):
        before = rows
        rows, held, radius = _assigned(before.select("vec_id", "vector"), tree)
        drop_kept(before)
    radii = tree.radii(radius)
    total = asked.count()
    few = F.pmod(F.xxhash64("query_id", F.lit("trial")), F.lit(1_000_000)) < min(1.0, settings.trial / max(total, 1)) * 1_000_000
    trial = [(r["query_id"], np.array(r["vector"])) for r in asked.where(few).orderBy("query_id").toLocalIterator()]
    visits = tree.leaves
    if trial:
        best = _ranked(_brute(trial, rows, k), k).join(rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
        order = {i: {leaf: place for place, leaf in enumerate(tree.best_first(q, radii))} for i, q in trial}
        needed = np.sort([order[r["query_id"]][r["leaf"]] + 1 for r in best])
        if len(needed):
            visits = int(needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))))])
    return tree, radii, held, visits, sample, sample_ids, rows, asked


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product that the tree finds, nearest first, ties to the smaller id.

    vectors and queries have the columns key and vector. The tree is fitted on a bounded sample and indexes every
    row; a leaf is searched in blocks of a fixed size, so a vector that many rows share is dealt to many tasks.
    Queries visit leaves best bin first, as many as a calibration against brute force needs for the recall that
    the settings ask for, and more where these hold fewer than k rows. The number of leaves grows with the rows, up to
    settings.most. Vectors that are null, zero, of another length than most, or hold null or non-finite components take
    no part, nor do rows with a null key. Repeated ids are candidates each; a query's own id never is, and of a query id
    with several vectors the least one counts. An empty table of either kind gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        ok = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector")).where(ok)

    index = fit_index(usable(vectors), usable(queries), k, settings)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, radii, held, visits, sample, sample_ids, rows, asked = index
    plan = spark.sparkContext.broadcast((tree, radii, held, visits, sample, sample_ids, tree.assign(sample)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, radii, held, visits, sample, sample_ids, sample_leaf = plan.value
        for batch in batches:
            leaves, bounds = [], []
            for vector, own in zip(batch["vector"], batch["query_id"], strict=True):
                q, mine, seen = np.asarray(vector, dtype=float), [], 0
                for place, leaf in enumerate(tree.best_first(q, radii)):
                    if place >= visits and seen > k:
                        break
                    mine.append(leaf)
                    seen += held[leaf]
                leaves.append(mine)
                # the k-th best of the sample in the visited leaves is a lower bound of the k-th best of all rows there
                visited = np.zeros(tree.leaves, dtype=bool)
                visited[mine] = True
                scores = (sample @ q)[visited[sample_leaf] & (sample_ids != own)]
                bounds.append(np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf)
            bounds = np.array(bounds, dtype=float)
            yield batch.assign(leaves=leaves, bound=bounds - 1e-9 * (1 + np.abs(np.where(np.isfinite(bounds), bounds, 0))))

    blocks = F.greatest(F.lit(1), F.ceil(F.element_at(F.lit(np.maximum(1, held)).cast("array<long>"), (F.col("leaf") + 1).cast("int")) / settings.rows)).cast("long")
    visited = asked.mapInPandas(route, "query_id long, vector array<double>, leaves array<long>, bound double")
    visited = visited.select("query_id", "vector", "bound", F.explode("leaves").alias("leaf"))
    pairs = visited.select("query_id", "vector", "bound", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    dealt = rows.select("vec_id", "vector", "leaf", F.pmod(F.xxhash64("vec_id", F.lit("block")), blocks).alias("block"))
    return _ranked(_search(pairs, dealt, k), k)
