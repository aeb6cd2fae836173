"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import in_groups, kept, partitions, tune

#: Two fingerprints within two bits agree in one of three blocks of 21 bits; in the trie of the fingerprints that are
#: rotated so that this block leads, their paths do not part in the first 21 levels.
TOP = 21


def shingles(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, 42) for g in grams], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority bits over the hashes of all shingles; 0 for a text without words."""
    return majority(shingles(text, width))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """(key, fp long). fp holds the 64 bits in two's complement."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    out = source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fp long")
    return out.withColumnRenamed("key", key)


def trie_links(values: np.ndarray, pairs: list[np.ndarray], depth: np.ndarray, budget: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk pairs of trie nodes together and give the leaf pairs that differ in at most budget[64] bits.

    A node is a range of `values`, in which rows that share a node are adjacent and sorted. pairs: the
    arrays low and high of the first nodes, then those of the second ones, then the bits in which their
    prefixes already differ. depth: bits consumed so far, 0 for the root paired with itself. A pair goes to a
    direct comparison when both nodes hold one value; it is dropped as soon as its prefixes of d bits differ in
    more than budget[d] bits.
    """
    ones: dict[int, np.ndarray] = {}
    most = int(budget[64])

    def split(low, high, bit):
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1)))).astype(np.int64)
        return high - (ones[bit][high] - ones[bit][low])

    stack = [(int(d), [p[depth == d] for p in pairs]) for d in np.unique(depth)]
    while stack:
        bit, (al, ah, bl, bh, off) = stack.pop()
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (np.bitwise_count(values[i] ^ values[j]) <= most) & (i != j)
            yield i[near], j[near]
        rest = ~single
        al, ah, bl, bh, off = (x[rest] for x in (al, ah, bl, bh, off))
        if not len(al):
            continue
        if bit == 64:  # equal values may repeat in a node
            yield np.concatenate([np.full(n, a) for a, n in zip(al, bh - bl, strict=True)]), np.concatenate([np.arange(x, y) for x, y in zip(bl, bh, strict=True)])
            yield np.concatenate([np.arange(x, y) for x, y in zip(al, ah, strict=True)]), np.concatenate([np.full(n, b) for b, n in zip(bl, ah - al, strict=True)])
            continue
        if len(al) > chunk:
            for k in range(0, len(al), chunk):
                stack.append((bit, [x[k : k + chunk] for x in (al, ah, bl, bh, off)]))
            continue
        am, bm = split(al, ah, bit), split(bl, bh, bit)
        same = (al == bl) & (ah == bh)
        new = [[al, am, bl, bm, off], [am, ah, bm, bh, off], [al, am, bm, bh, off + 1]]
        cross = ~same
        new.append([x[cross] for x in (am, ah, bl, bm, off + 1)])
        al, ah, bl, bh, off = (np.concatenate(x) for x in zip(*new, strict=True))
        live = (ah > al) & (bh > bl) & (off <= budget[bit + 1]) & ~((al == bl) & (ah - al == 1) & (bh - bl == 1))
        stack.append((bit + 1, [x[live] for x in (al, ah, bl, bh, off)]))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's component; links are merged as they come, none is held."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (shorter := label[label])).any():
                label = shorter
    return label


def _join_task(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = np.where(np.arange(65) <= TOP, 0, most)
        for frame in in_groups(batches, "gid", 100_000):
            side, rot, refined = frame["side"].to_numpy(), frame["rot"].to_numpy().view(np.uint64), frame["depth"].to_numpy() > TOP
            trie = np.where(refined, frame["gid"].to_numpy(), frame["r"].to_numpy())  # the rows of a rotation are one trie, walked from its root
            order = np.lexsort((rot, side, trie, refined))
            trie, side, rot, refined = trie[order], side[order], rot[order], refined[order]
            fp, depth, off = (frame[c].to_numpy()[order] for c in ("fp", "depth", "off"))
            depth = np.where(refined, depth, 0)
            start = np.flatnonzero(np.r_[True, (trie[1:] != trie[:-1]) | (side[1:] != side[:-1]) | (refined[1:] != refined[:-1])])
            end = np.r_[start[1:], len(trie)]
            s = side[start]
            own = (s == 0) & (end - start > 1)
            first = np.flatnonzero((s[:-1] == 1) & (s[1:] == 2) & (trie[start[:-1]] == trie[start[1:]]))
            pairs = [np.concatenate(x) for x in ((start[own], start[first]), (end[own], end[first]), (start[own], start[first + 1]), (end[own], end[first + 1]))]
            pairs.append(off[pairs[0]])
            label = _forest(len(trie), trie_links(rot, pairs, depth[pairs[0]], budget))
            moved = fp != fp[label]
            yield pd.DataFrame({"a": fp[moved], "b": fp[label][moved]})

    return run


def _children(nodes: DataFrame, most: int, bits: int) -> DataFrame:
    """Refine node pairs by some more bits: a row goes to each pair of child nodes that its own child can be in.

    Pairs whose differing bits exceed the budget, and pairs that have rows on one side only, are pruned.
    """
    child = F.shiftrightunsigned(F.call_function("shiftleft", F.col("rot"), F.col("depth")), 64 - bits)
    other = F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)))
    out = nodes.withColumn("c", child.cast("int")).withColumn("o", other)
    out = out.withColumn("off", F.col("off") + F.bit_count(F.col("c").bitwiseXOR(F.col("o")))).where(F.col("off") <= most)
    first = F.when(F.col("side") == 0, F.least("c", "o")).when(F.col("side") == 1, F.col("c")).otherwise(F.col("o"))
    second = F.when(F.col("side") == 0, F.greatest("c", "o")).when(F.col("side") == 1, F.col("o")).otherwise(F.col("c"))
    side = F.when((F.col("side") != 0), F.col("side")).when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    out = out.select(F.xxhash64(F.col("gid"), F.col("depth"), first, second).alias("gid"), side.alias("side"), "r", "rot", "fp", (F.col("depth") + bits).cast("int").alias("depth"), "off")
    full = out.groupBy("gid").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("side"))).alias("sides")).where("sides not in (2, 4)")
    return out.join(full.select("gid"), "gid", "left_semi").select("gid", "side", "r", "rot", "fp", "depth", "off")


def near_links(fps: DataFrame, most: int = 2, max_node: int = 1024, bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within `most` (0 to 2) bits.

    Binary trie self-join over all 64 bits, dealt to tasks: two fingerprints that close agree in one of three blocks
    of 21 bits, so each fingerprint goes into three tries, rotated so that one block after another leads, and a pair
    may differ nowhere in the leading block and in `most` bits in all. Subtries of equal leading blocks go to one
    task, which walks pairs of nodes from the root of what it holds. A subtrie of more than max_node rows is first
    refined into pairs of child nodes by the same budget, which are tasks of their own. A task emits a spanning forest
    instead of all pairs of a dense cluster: no component is lost.
    """
    rotated = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), (F.col("fp") if not r else F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r))).alias("rot")) for r in (0, TOP, 2 * TOP)]))
    nodes = fps.select("fp").distinct().select("fp", rotated.alias("x")).select("fp", "x.r", "x.rot")
    nodes = nodes.select(F.xxhash64("r", F.shiftrightunsigned("rot", 64 - TOP)).alias("gid"), F.lit(0).alias("side"), F.col("r").cast("byte").alias("r"), "rot", "fp", F.lit(TOP).alias("depth"), F.lit(0).alias("off"))
    ready = []
    while True:
        nodes = kept(nodes, "trie")
        size = nodes.groupBy("gid").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
        hot = size.where((F.col("n") > max_node) & (F.col("d") + bits <= 64)).select("gid")
        ready.append(nodes.join(hot, "gid", "left_anti"))
        if hot.isEmpty():
            break
        nodes = _children(nodes.join(hot, "gid", "left_semi"), most, bits)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition(partitions(fps.sparkSession), "gid").sortWithinPartitions("gid")
    return rows.mapInPandas(_join_task(most), "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, most: int = 2) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (least key reachable), component_size.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows each get a row.
    Other columns of docs, whatever their names, are not read. An empty table gives an empty result.
    """
    fps = kept(fingerprints(docs, text, key, width), "fingerprints")
    one = kept(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "classes")
    roots = components(near_links(one, most), "a", "b")
    classes = one.join(roots, one["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    sums = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    classes = kept(classes.select("fp", "root").join(sums, "root").select("fp", "component_id", "component_size"), "classes")
    return fps.join(classes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def simhash_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, most: int = 2) -> DataFrame:
    """docs without all but the document of the least key of each near-duplicate group; all columns stay.

    Rows that repeat that document's key stay together; rows with a null key are in no group and stay.
    """
    keep = simhash_groups(docs.where(F.col(key).isNotNull()), text, key, width, most).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct()
    return docs.join(keep, docs[key] == keep["__gone"], "left_anti")
