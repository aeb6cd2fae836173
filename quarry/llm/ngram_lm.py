"""Language-model scores from a log-frequency Bloom filter of n-gram counts, beside exact unigram scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.langid import fold
from quarry.llm.shared import kept, partitions, shared_dir, tune

#: What ends a text, and what precedes its first token; no word holds a blank.
END, BEGIN = b" ", b"  "
BLOCK_BITS = 15
PROBES = 5


@dataclass(frozen=True)
class Size:
    """blocks (a power of two, 2 at least) make the filter, each of as many pages of 4 KiB as its n-grams need; room: bits for each
    insertion; head: unigrams whose exact counts are broadcast; part: bytes of the filter and its contexts that a worker holds at a
    time, at least a block. None depends on the corpus; the filter's size does."""

    blocks: int = 4096
    room: int = 12
    head: int = 1 << 20
    part: int = 1 << 26


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def _tokens(texts: list, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, of the one before it, tokens in each text)."""
    out: list[int] = []
    sizes, end = [], hashes[END]
    for text in texts:
        before = len(out)
        if text:
            out += [hashes[w] for w in text.lower().split()]
        out.append(end)
        sizes.append(len(out) - before)
    now = np.array(out, dtype=np.uint64)
    was = np.empty_like(now)
    was[1:] = now[:-1]
    was[np.cumsum([0, *sizes[:-1]])] = hashes[BEGIN]
    return now, was, np.array(sizes, dtype=np.int64)


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    for shift, times in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        x = x ^ (x >> np.uint64(shift)) ^ (x >> np.uint64(min(63, 2 * shift)))
        x = x * np.uint64(pow(times, -1, 1 << 64))
    return x


def _pair(was: np.ndarray, now: np.ndarray) -> np.ndarray:
    """A key from the leading 32 bits of two words' hashes, from which the first word's can be had back."""
    high = np.uint64(32)
    return mix((was >> high << high) | (now >> high))


def _context(word: np.ndarray) -> np.ndarray:
    return word >> np.uint64(32) << np.uint64(32)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _page(h: np.ndarray, blocks: int, pages: np.ndarray) -> np.ndarray:
    """The page of each key within its block, by the bits that follow those which name the block."""
    return (((h << np.uint64(blocks.bit_length() - 1)) >> np.uint64(32)) * pages.astype(np.uint64)) >> np.uint64(32)


def _positions(h: np.ndarray, level: int, page: np.ndarray) -> list[np.ndarray]:
    x = mix(h + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    low = np.uint64((1 << BLOCK_BITS) - 1)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [(page << np.uint64(BLOCK_BITS)) + ((x + np.uint64(i) * step) & low) for i in range(PROBES)]


def quantised(n: np.ndarray) -> np.ndarray:
    """Levels of a count: 1 + floor(log2 n)."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


#: The count that a level stands for; whole numbers.
COUNTS = np.array([0.0, 1.0, *(1.5 * 2.0 ** (level - 1) for level in range(2, 64))])
#: A context in a part's list: its key, the quantised counts of all that follows it, and how many different tokens do.
CONTEXT = np.dtype([("key", "<u8"), ("total", "<f8"), ("kinds", "<i8")])


def smoothed(q2: np.ndarray, total: np.ndarray, kinds: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Witten-Bell: a token's probability after a context, from quantised counts; over all tokens and the unknown one it sums to 1."""
    return (np.minimum(q2, total) + kinds * p1) / np.maximum(total + kinds, 1) + (kinds == 0) * p1


class LogFilter:
    """A Bloom filter that holds (n-gram, 1) to (n-gram, level) for each n-gram of a quantised count.

    pages: those of each block, one by default. bits: all blocks in order, or those from page `start` on.
    """

    def __init__(self, bits: np.ndarray, blocks: int, pages: np.ndarray | None = None, start: int = 0):
        self.bits, self.blocks = bits, blocks
        self.pages = np.ones(blocks, dtype=np.int64) if pages is None else pages
        self.first = np.cumsum(self.pages) - self.pages - start

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels by membership probes of growing level, until one fails; some keys at a time, to hold little."""
        done = [self._levels(h[i : i + (1 << 18)]) for i in range(0, len(h), 1 << 18)]
        return np.concatenate(done) if done else np.zeros(0, dtype=np.uint8)

    def _levels(self, h: np.ndarray) -> np.ndarray:
        level = np.zeros(len(h), dtype=np.uint8)
        block = h >> np.uint64(64 - self.blocks.bit_length() + 1)
        pages = self.pages[block]
        page = self.first[block].astype(np.uint64) + _page(h, self.blocks, pages)
        live = np.flatnonzero(pages > 0)
        while len(live):
            at, own = h[live], page[live]
            hit = np.ones(len(live), dtype=bool)
            for p in _positions(at, int(level[live[0]]) + 1, own):
                hit &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            level[live] += 1
            if len(live) and level[live[0]] >= 62:
                break
        return level

    def counts(self, h: np.ndarray) -> np.ndarray:
        return COUNTS[self.levels(h)]


def count_ngrams(docs: DataFrame, size: Size) -> DataFrame:
    """(kind, key, n, m, bits): kind 1 has each token's exact count; kind 0 each block of the filter and its insertions; kind 2 each
    context with the sum of the quantised counts of what follows it, and m, how many different tokens do, in parts to be summed.

    Tasks sum the counts of what they read before the shuffle, so a frequent n-gram is one row a task. Keys are
    dealt by their leading bits, which name the block, so a block is built in one place from all its n-grams. It
    takes as many pages as they need: every n-gram is inserted.
    """
    shift = 64 - (size.blocks.bit_length() - 1)

    def count(batches):
        import pyarrow as pa

        hashes = _Hashes()
        held: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
        rows = 0

        def flush(last: bool):
            nonlocal rows
            rows = 0
            for kind, (keys, counts) in held.items():
                if keys:
                    k, n = _sum(keys, counts)
                    if last or len(k) > 1_500_000:
                        keys.clear(), counts.clear()
                        for at in range(0, len(k), 100_000):
                            part = k[at : at + 100_000]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(n[at : at + 100_000])], names=["kind", "key", "n"])
                    else:
                        keys[:], counts[:] = [k], [n]
                        rows += len(k)

        for batch in batches:
            now, was, _ = _tokens(batch.column(0).to_pylist(), hashes)
            for kind, keys in ((1, now), (2, _pair(was, now))):
                k, n = np.unique(keys, return_counts=True)
                held[kind][0].append(k)
                held[kind][1].append(n)
                rows += len(k)
            if rows > 4_000_000:
                yield from flush(False)
        yield from flush(True)

    def build(batches):
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
        rows = 0
        for batch in batches:
            kind, keys, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "n"))
            for k in (1, 2):
                own = kind == k
                held[k][0].append(keys[own].view(np.uint64))
                held[k][1].append(n[own])
            rows += len(kind)
            if rows > 4_000_000:
                for k in (1, 2):
                    a, b = _sum(*held[k])
                    held[k] = ([a], [b])
                rows = 0
        if not any(x[0] for x in held.values()):
            return
        done = [_sum(*held[k]) for k in (1, 2)]
        words, n = done[0]
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), 1, np.int8)), pa.array(part.view(np.int64)), pa.array(n[at : at + 100_000]), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())], names=["kind", "key", "n", "m", "bits"])
        contexts, where = np.unique(_context(unmix(done[1][0])), return_inverse=True)
        totals = np.bincount(where, weights=COUNTS[quantised(done[1][1])], minlength=len(contexts)).astype(np.int64)
        kinds = np.bincount(where, minlength=len(contexts))
        for at in range(0, len(contexts), 100_000):
            part = contexts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), 2, np.int8)), pa.array(part.view(np.int64)), pa.array(totals[at : at + 100_000]), pa.array(kinds[at : at + 100_000]), pa.nulls(len(part), pa.binary())], names=["kind", "key", "n", "m", "bits"])
        keys, n = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        levels, block = quantised(n), keys >> np.uint64(shift)
        order = np.argsort(block, kind="stable")
        keys, levels, block = keys[order], levels[order], block[order]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            h, q = keys[a:b], levels[a:b]
            inserted = int(q.sum())
            pages = -(-inserted * size.room >> BLOCK_BITS)
            page = _page(h, size.blocks, np.full(len(h), pages))
            flags = np.zeros(pages << BLOCK_BITS, dtype=np.uint8)
            for level in range(1, int(q.max()) + 1):
                own = q >= level
                for p in _positions(h[own], level, page[own]):
                    flags[p] = 1
            bits = np.packbits(flags, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([int(block[a])], pa.int64()), pa.array([inserted], pa.int64()), pa.nulls(1, pa.int64()), pa.array([bits], pa.binary())], names=["kind", "key", "n", "m", "bits"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(count, "kind byte, key long, n long")
    dealt = counted.repartition(partitions(docs.sparkSession), F.shiftrightunsigned("key", shift))
    return kept(dealt.mapInArrow(build, "kind byte, key long, n long, m long, bits binary"), "ngrams")


def _stored(rows: DataFrame, what: str) -> dict[int, str]:
    """Write the bytes of each part's rows (part, key, bits), in the order of keys, to a file in the shared folder: part to its URI."""
    folder = shared_dir(rows.sparkSession, what)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        part = out = None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k != part:
                    if out is not None:
                        out.close()
                    part, name = k, f"{k}-{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(f"{place}/{name}")
                    done.append((k, f"{folder}/{name}"))
                out.write(bits.as_buffer())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["part", "uri"])

    rows = rows.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", "key")
    return {r["part"]: r["uri"] for r in rows.mapInArrow(write, "part long, uri string").collect()}


def _contexts(counts: DataFrame, name: int) -> DataFrame:
    """(block, key, bits): each context's totals as the bytes of CONTEXT; key is ordered without a sign."""
    sums = counts.where("kind = 2").groupBy("key").agg(F.sum("n").cast("double").alias("n"), F.sum("m").alias("m"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            rows = np.zeros(len(batch), dtype=CONTEXT)
            for field, column in zip(("key", "total", "kinds"), batch.columns, strict=True):
                values = column.to_numpy(zero_copy_only=False)
                rows[field] = values.view(np.uint64) if field == "key" else values
            order = (rows["key"] ^ np.uint64(1 << 63)).view(np.int64)
            data = rows.tobytes()
            ends = np.arange(0, len(data) + 1, CONTEXT.itemsize, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array((rows["key"] >> np.uint64(64 - name)).view(np.int64)), pa.array(order), packed], names=["block", "key", "bits"])

    return sums.select("key", "n", "m").mapInArrow(pack, "block long, key long, bits binary")


def score_texts(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", size: Size = Size()) -> DataFrame:
    """docs' columns but text, then n_tokens, n_known, train_tokens, base_score and score (columns of these names are replaced).

    base_score is exact: the counts of the most frequent tokens are broadcast, up to size.head of them; all
    others are joined by a shuffle. score sums the log10 of Witten-Bell probabilities of each token after the one
    before it, from quantised bigram and unigram counts: those of all tokens and one unknown token sum to 1 in any
    context, but for the filter's false positives. Workers read the filter part by part: the parts lie in the
    shared folder, and a worker holds one of them with the totals of its contexts. Texts of any length are scored
    whole. A null text counts as empty: one token, the end. Without training texts every count is zero and every
    token's probability 1. Repeated rows are scored each for itself; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tune(spark)
    counts = count_ngrams(training.select(F.col(text).alias("text")), size)
    words = counts.where("kind = 1").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, kinds = int(total["n"]), int(total["v"])
    by_log = {r["b"]: r["c"] for r in words.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
    least, room = 64, size.head
    while least > 0 and room >= by_log.get(least - 1, 0):
        least -= 1
        room -= by_log.get(least, 0)
    least = 1 << least
    head = words.where(F.col("n") >= least).toArrow()
    head_keys, head_n = head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()
    order = np.argsort(head_keys)
    filters = counts.where("kind = 0").select("key", "bits")
    pages = np.zeros(size.blocks, dtype=np.int64)
    for r in filters.select("key", F.length("bits").alias("size")).collect():
        pages[r["key"]] = r["size"] >> (BLOCK_BITS - 3)
    name = size.blocks.bit_length() - 1
    shift = name
    held = pages << (BLOCK_BITS - 3)
    for r in words.groupBy(F.shiftrightunsigned("key", 64 - name).alias("block")).agg(F.count("*").alias("n")).collect():
        held[r["block"]] += r["n"] * CONTEXT.itemsize  # a context for each word at most, but for the beginning
    while shift and held.reshape(-1, 1 << shift).sum(axis=1).max() > size.part:
        shift -= 1
    stored = _stored(filters.select(F.shiftright("key", shift).alias("part"), "key", "bits"), "filter")
    listed = _stored(_contexts(counts, name).select(F.shiftright("block", shift).alias("part"), "key", "bits"), "contexts")
    ones_total = float(sum(COUNTS[b + 1] * c for b, c in by_log.items()))
    shipped = spark.sparkContext.broadcast((head_keys[order], head_n[order], pages))
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    others = [c for c in docs.columns if c != text and c not in new]
    norm = np.log10(n_all + kinds + 1)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        keys, n, pages = shipped.value
        hashes, at = _Hashes(), TaskContext.get().partitionId() << 36
        loaded: dict[int, tuple[LogFilter, np.ndarray]] = {}

        def read(uri: str | None, kind) -> np.ndarray:
            if uri is None:
                return np.zeros(0, dtype=kind)
            store, place = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(place) as f:
                return np.frombuffer(f.read(), dtype=kind)

        def part(k: int) -> tuple[LogFilter, np.ndarray]:
            if k not in loaded:
                loaded.clear()
                loaded[k] = LogFilter(read(stored[k], np.uint8), size.blocks, pages, int(pages[: k << shift].sum())), read(listed.get(k), CONTEXT)
            return loaded[k]

        def gathered():
            """Batches with the levels of their distinct tokens and of their pairs; with several parts, as many
            batches at a time as have 4 M tokens: each part is read once for all of them."""
            held: list = []
            for batch in batches:
                now, was, sizes = _tokens(batch.column(batch.num_columns - 1).to_pylist(), hashes)
                unique, where = np.unique(np.r_[now, np.uint64(hashes[BEGIN])], return_inverse=True)
                held.append((batch.columns[:-1], now, was, sizes, unique, where.astype(np.int32)))
                if len(stored) < 2 or sum(len(x[1]) for x in held) >= 4_000_000:
                    yield from looked_up(held)
                    held.clear()
            yield from looked_up(held)

        def looked_up(held: list):
            ones, twos = ([np.zeros(len(x[i]), dtype=np.uint8) for x in held] for i in (4, 1))
            after = [np.zeros((2, len(x[4]))) for x in held]
            for k in sorted(stored, key=lambda k: k not in loaded) if held else ():
                for x, one, two, sums in zip(held, ones, twos, after, strict=True):
                    for h, level in ((x[4], one), (_pair(x[2], x[1]), two)):
                        own = np.flatnonzero(h >> np.uint64(64 - name) >> np.uint64(shift) == k) if len(stored) > 1 else slice(None)
                        level[own] = part(k)[0].levels(h[own])
                    contexts, u = part(k)[1], _context(x[4])
                    if len(contexts):
                        place = np.minimum(np.searchsorted(contexts["key"], u), len(contexts) - 1)
                        found = contexts["key"][place] == u
                        sums[:, found] = contexts["total"][place[found]], contexts["kinds"][place[found]]
            for x, one, two, sums in zip(held, ones, twos, after, strict=True):
                yield *x, COUNTS[one], COUNTS[two], sums

        for columns, now, _, sizes, unique, where, one, two, after in gathered():
            begin, where = where[-1], where[:-1]
            c, found = np.zeros(len(unique)), np.zeros(len(unique), dtype=bool)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                found = keys[place] == unique
                c[found] = n[place[found]]
            first = np.cumsum(np.r_[0, sizes[:-1]])
            u = np.empty(len(now), dtype=np.int32)  # the place of the token before, among the different ones
            u[1:] = where[:-1]
            u[first] = begin
            p1 = (one[where] + 1) / (ones_total + kinds + 1)
            p = smoothed(np.where(one[where] > 0, two, 0), after[0][u], after[1][u], p1)
            rest = ~found[where]
            tails = np.add.reduceat(rest.astype(np.int64), first)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tails)].astype(np.int32)), pa.array(now[rest].view(np.int64)))
            sums = [np.add.reduceat(x, first) for x in (found[where].astype(np.int64), np.log10(c + 1)[where], np.log10(p))]
            made = [pa.array(np.arange(at, at + len(sizes))), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), lists]
            at += len(sizes)
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[f"c{i}" for i in range(len(others))] + ["row", "size", "known", "logs", "score", "tail"])

    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text).cast("binary").alias("__text"))
    schema = ", ".join([f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(others))] + ["row long, size long, known long, logs double, score double, tail array<long>"])
    scored = kept(source.mapInArrow(run, schema), "scores")
    tail = scored.select("row", F.explode("tail").alias("key")).join(words.where(F.col("n") < least), "key")
    tail = tail.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    out = scored.drop("tail").join(tail, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("size") * F.lit(float(norm))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.col("size").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned outside remainder 2 of 7.

    A null doc_id has no remainder: such a row teaches nothing and counts as not held out.
    """
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    return score_texts(rows, docs.where(fold("doc_id", 7) != 2))
