"""Near-duplicates by exact Jaccard similarity of word shingles; candidates by SimHash and by MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import by_keys, drop_kept, in_groups, kept, named, partitions, trim, tune
from quarry.llm.simhash import majority, near_links, shingles

#: A pair of similarity 0.8 shares one of 30 bands of 6 minima with a probability of 1 - (1 - 0.8^6)^30 = 0.9999.
BANDS, ROWS = 30, 6
_RANDOM = np.random.default_rng(7)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(unique: np.ndarray) -> np.ndarray:
    """A hash for each band of minima; none for an empty set."""
    if not len(unique):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(unique), 4096):
        x = unique[None, at : at + 4096] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def _class(unique: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(unique.tobytes(), 42)


def linked(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The least index of each set's component under Jaccard similarity of `least` or more; all pairs count."""
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    work: list[int] = []
    while len(left):
        if not work:
            work.append(int(left[0]))
            flat, left = flat[size[left[0]] :], left[1:]
            continue
        x = work.pop()
        own = sets[x]
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(size[left]) - size[left])
        near = both >= least * (size[x] + size[left] - both)
        label[left[near]] = label[x]
        work += left[near].tolist()
        flat, left = flat[np.repeat(~near, size[left])], left[~near]
    return label


def crossed(new: list[np.ndarray], others: list[np.ndarray], one: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (place in new, place in others) that join all sets of a similarity of `least` or more; others with the flag `one` are joined already."""
    label = np.arange(len(others) + len(new))
    if one.any():
        label[: len(others)][one] = np.flatnonzero(one)[0]
    size = np.array([len(s) for s in others])
    flat, begin = np.concatenate(others), np.cumsum(size) - size
    links = []
    for i, x in enumerate(new):
        place = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        both = np.add.reduceat((x[place] == flat).astype(np.int64), begin)
        near = np.flatnonzero(both >= least * (size + len(x) - both))
        roots, first = np.unique(label[near], return_index=True)
        for root, j in zip(roots, near[first], strict=True):
            mine = label[len(others) + i]
            if root != mine:
                links.append((i, int(j)))
                label[label == max(root, mine)] = min(root, mine)
    return links


def _large_links(sets: DataFrame, sizes: DataFrame, least: float, tile: int, chunk: int) -> DataFrame:
    """(a, b): links of candidate groups that are too large for a task. sets: (root, cls, grams); sizes: (root, n).

    Each class is compared with the group's least class; those near to it are one component. All others are dealt
    in tiles, the whole group in chunks, and a task compares a tile with a chunk: no pair of different components is
    left out, and a group of copies of one text costs one comparison a class.
    """
    rows = sets.join(sizes, "root")
    pivots = rows.groupBy("root").agg(F.min_by("grams", "cls").alias("pivot_grams"), F.min("cls").alias("pivot"))
    both = F.size(F.array_intersect("grams", "pivot_grams"))
    near = both >= least * (F.size("grams") + F.size("pivot_grams") - both)
    starred = kept(rows.join(pivots, "root").select("root", "n", "cls", "grams", "pivot", near.alias("near")), "starred")
    links = starred.where(F.col("near") & (F.col("cls") != F.col("pivot"))).select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    left = kept(starred.where(~F.col("near")).groupBy("root").agg(F.count("*").alias("left")), "left")
    if left.isEmpty():
        return links
    spots = starred.join(left, "root")
    tiles, chunks = F.ceil(F.col("left") / tile).cast("int"), F.ceil(F.col("n") / chunk).cast("int")
    own, every = (lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    new = spots.where(~F.col("near")).select("root", own(tiles).alias("t"), every(chunks).alias("c"), F.lit(0).alias("side"), "cls", "near", "grams")
    others = spots.select("root", every(tiles).alias("t"), own(chunks).alias("c"), F.lit(1).alias("side"), "cls", "near", "grams")
    dealt = new.unionByName(others).select(F.xxhash64("root", "t", "c").alias("gid"), "root", "side", "cls", "near", "grams")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_groups(batches, "gid", 1):
            for _, group in frame.groupby(["gid", "root"]):
                a, b = group[group["side"] == 0], group[group["side"] == 1]
                if len(a) and len(b):
                    found = crossed(_arrays(a["grams"]), _arrays(b["grams"]), b["near"].to_numpy(), least)
                    x, y = a["cls"].to_numpy(), b["cls"].to_numpy()
                    yield pd.DataFrame({"a": [x[i] for i, j in found if x[i] != y[j]], "b": [y[j] for i, j in found if x[i] != y[j]]}, dtype="int64")

    dealt = dealt.repartition(partitions(sets.sparkSession), "gid").sortWithinPartitions("gid")
    return links.unionByName(dealt.mapInPandas(compare, "a long, b long"))


def _arrays(grams: pd.Series) -> list[np.ndarray]:
    return [np.asarray(g, dtype=np.int64).view(np.uint64) for g in grams]


def jaccard_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, least: float = 0.8, group: int = 1024, tile: int = 256) -> DataFrame:
    """docs without all but the document of the least key of each near-duplicate group; all columns stay.

    Groups are the components of pairs whose sets of shingles have a Jaccard similarity of `least` or more. Texts of
    one set are one class. Classes that share a band, or whose SimHash fingerprints are within 2 bits, fall into one
    candidate group; within it every pair of different components is checked. A group of up to `group` classes is one
    task's, larger ones are dealt to many. Texts without words, null ones too, are one class. Texts of any length are
    shingled whole. Rows that repeat the kept document's key stay together; rows with a null key are in no group and
    stay. An empty table gives an empty one; a column __gone is reserved, others may have any name.
    """
    spark = docs.sparkSession
    tune(spark)

    def sign(batches):
        import pyarrow as pa

        trim()
        for batch in batches:
            cls, fps, marks = [], [], []
            for t in batch.column(1).to_pylist():
                hashes = shingles(t, width)
                unique = np.unique(hashes)
                cls.append(_class(unique))
                fps.append(majority(hashes))
                marks.append(bands(unique))
            ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            marked = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *marks])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (cls, fps)), marked], names=["key", "cls", "fp", "bands"])

    def sets(batches):
        import pyarrow as pa

        trim()
        for batch in batches:
            found = [np.unique(shingles(t, width)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_class(u) for u in found], dtype=np.uint64).view(np.int64)), pa.array([u.view(np.int64) for u in found], pa.list_(pa.int64()))], names=["cls", "grams"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for frame in in_groups(batches, "root", 2000):
            for _, group in frame.groupby("root"):
                cls = group["cls"].to_numpy()
                label = linked(_arrays(group["grams"]), least)
                moved = label != np.arange(len(label))
                yield pd.DataFrame({"a": cls[moved], "b": cls[label][moved]})

    source = docs.where(named(key)[0].isNotNull()).select(named(key)[0].alias("key"), named(text)[0].cast("binary").alias("text"))
    signed = kept(source.mapInArrow(sign, f"key {source.schema['key'].dataType.simpleString()}, cls long, fp long, bands array<long>"), "signed")
    classes = kept(signed.groupBy("cls").agg(F.min("key").alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "classes")
    marks = classes.where(F.size("bands") > 0).select("cls", F.explode("bands").alias("mark"))
    stars = marks.groupBy("mark").agg(F.min("cls").alias("v")).join(marks, "mark").where("cls != v").select(F.col("cls").alias("a"), F.col("v").alias("b"))
    prints = kept(classes.where(F.size("bands") > 0).groupBy("fp").agg(F.min("cls").alias("v")), "prints")
    same = classes.where(F.size("bands") > 0).join(prints, "fp").where("cls != v").select(F.col("cls").alias("a"), F.col("v").alias("b"))
    near = near_links(prints).join(prints.select(F.col("fp").alias("a"), F.col("v").alias("va")), "a").join(prints.select(F.col("fp").alias("b"), F.col("v").alias("vb")), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    maybe = components(stars.unionByName(same).unionByName(near), "a", "b")
    maybe = maybe.unionByName(maybe.select(F.col("root").alias("node"), "root").distinct())  # a root is no node of its own
    maybe = kept(maybe.select(F.col("node").alias("cls"), "root").join(classes.select("cls", "least"), "cls"), "candidates")
    firsts = kept(maybe.select(F.col("least").alias("key")).distinct(), "firsts")
    texts = by_keys(source, firsts, source["key"] == firsts["key"], "left_semi").select("text")
    grams = kept(texts.mapInArrow(sets, "cls long, grams array<long>").join(maybe.select("cls", "root"), "cls").dropDuplicates(["cls"]).select("root", "cls", "grams"), "grams")
    sizes = kept(maybe.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > group), "sizes")
    small = by_keys(grams, sizes, grams["root"] == sizes["root"], "left_anti")
    dealt = small.repartition(partitions(spark), "root").sortWithinPartitions("root", "cls")
    links = kept(dealt.mapInPandas(check, "a long, b long").unionByName(_large_links(grams, sizes, least, tile, 2 * group)), "links")
    drop_kept(grams)
    roots = components(links, "a", "b")
    grouped = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    first = grouped.groupBy("root").agg(F.min("least").alias("first"))
    gone = signed.select("key", "cls").join(grouped.select("cls", "root").join(first, "root"), "cls").where("key != first")
    gone = kept(gone.select(F.col("key").alias("__gone")).distinct(), "gone")
    return by_keys(docs, gone, named(key)[0] == gone["__gone"], "left_anti")
