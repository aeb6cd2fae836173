"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.shared import kept, partitions, trim, tune

#: A-Z lower-cased and ASCII punctuation as blanks; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words are hashed to so many buckets, which bounds the latent space whatever the benchmark's vocabulary.
BUCKETS = 1 << 16
#: Windows begin every 4 words for items of fewer than 12 words; every 16 for those below 16 * 12, every 64 below 64 * 12, and so on.
STEP, STEP_WORDS = 4, 12
#: Windows of two and of four steps, one of each from every step on.
WIDTHS = (2, 4)
#: Items of fewer words are looked up word for word.
LEAST_WORDS = 5
#: Bits of the signatures that tell which buckets a step's or an item's words have.
SIGNATURE = 1024


@dataclass(frozen=True)
class Rules:
    """cosine: from which a window is compared with an item. lcs: share of the item's words, in order, that proves a
    leak by itself; paraphrase: the share that does together with the answer, the item's last words."""

    rank: int = 128
    cosine: float = 0.5
    lcs: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.6
    answer_part: float = 0.25
    items_at_once: int = 4096


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        at = where.get(w, 0)
        if at:
            part = row & at
            row = ((row + part) | (row - part)) & full
    return len(a) - row.bit_count()


class Buckets(dict):
    """The row of a word's bucket in the latent space; `none` where no benchmark word has that bucket."""

    def __init__(self, live: np.ndarray):
        super().__init__()
        self.none = len(live)
        self.rows = [self.none] * BUCKETS
        for row, bucket in enumerate(live.tolist()):
            self.rows[bucket] = row

    def __missing__(self, word: bytes) -> int:
        row = self.rows[crc32(word) % BUCKETS]
        if len(self) >= 300_000:
            self.clear()
        self[word] = row
        return row


def document_frequencies(docs: DataFrame, text: str, live: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each live bucket, over all documents; and how many documents there are."""

    def run(batches):
        import pyarrow as pa

        row_of = Buckets(live).__getitem__
        total, n = np.zeros(len(live) + 1, dtype=np.int64), 0
        for batch in batches:
            n += len(batch)
            for value in batch.column(0).to_pylist():
                if value:
                    total[list(set(map(row_of, set(value.translate(FOLD).split()))))] += 1
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[total[some], n])], names=["w", "n"])

    rows = docs.select(F.col(text).cast("binary")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(live)), 0
    for r in rows:
        if r["w"] < 0:
            n = r["n"]
        else:
            out[r["w"]] = r["n"]
    return out, n


def live_buckets(texts: DataFrame) -> np.ndarray:
    """The buckets that words of a table of texts have."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(crc32(w) % BUCKETS for w in set(words(value)))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["b"])

    return np.array(sorted(r["b"] for r in texts.mapInArrow(run, "b int").distinct().collect()), dtype=np.int64)


def passages(texts: DataFrame, live: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(at, weight): the TF-IDF vector of each text over the live buckets, of length one; texts without words are left out."""

    def run(batches):
        import pyarrow as pa

        rows = Buckets(live)
        for batch in batches:
            ats, values = [], []
            for value in batch.column(0).to_pylist():
                if split := words(value):
                    at, tf = np.unique([rows[w] for w in split], return_counts=True)
                    v = tf * weights[at]
                    ats.append(at)
                    values.append(v / max(np.linalg.norm(v), 1e-12))
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["at", "weight"])

    return texts.mapInArrow(run, "at array<int>, weight array<double>")


def randomised_svd(rows: DataFrame, size: int, rank: int, rounds: int = 2, over: int = 8, chunk: int = 1024) -> np.ndarray:
    """The leading right singular vectors (size x rank) of a distributed sparse matrix of rows (at array, weight array).

    Range finding by products with the transposed matrix times the matrix: each partition multiplies its own
    rows, and the products are summed by a shuffle in chunks, so the driver receives one matrix of
    size x (rank + over), whatever the rows and their partitions.
    """
    rng = np.random.default_rng(7)
    width = min(rank + over, size)
    basis = np.linalg.qr(rng.standard_normal((size, width)))[0]
    spark = rows.sparkSession
    parts = max(1, min(partitions(spark), -(-size // chunk)))

    def product(q: np.ndarray) -> np.ndarray:
        shipped = spark.sparkContext.broadcast(q)

        def multiply(batches):
            import pyarrow as pa

            q, total = shipped.value, None
            for batch in batches:
                for at, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total = np.zeros_like(q) if total is None else total
                    weight = np.array(weight)
                    total[at] += np.outer(weight, weight @ q[at])  # the places of a row differ
            for k in range(0, size, chunk) if total is not None else ():
                part = total[k : k + chunk]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["k", "part"])

        def add(batches):
            import pyarrow as pa

            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(part)
            for k, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], names=["k", "part"])

        total = np.zeros_like(q)
        for r in rows.mapInArrow(multiply, "k long, part binary").repartition(parts, "k").mapInArrow(add, "k long, part binary").toLocalIterator():
            total[r["k"] : r["k"] + chunk] = np.frombuffer(r["part"]).reshape(-1, width)
        shipped.unpersist()
        return total

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


class Index:
    """Items of a benchmark in a latent space that all documents and items share."""

    def __init__(self, ids: list, texts: list[list[bytes]], live: np.ndarray, vectors: np.ndarray, rules: Rules):
        """vectors: the weighted latent vector of each live bucket."""
        self.ids, self.texts, self.live, self.rules = ids, texts, live, rules
        self.vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
        self.rows: Buckets | None = None
        rows = Buckets(live)
        #: A leak loses at most (1 - paraphrase) of an item's words, so at least so many different ones must be there.
        self.sets = [frozenset(t) for t in texts]
        self.least = [len(d) - (1 - rules.paraphrase) * len(t) for d, t in zip(self.sets, texts, strict=True)]
        self.short: dict[int, dict[tuple, list[int]]] = {}
        by_step: dict[int, list[int]] = {}
        for j, t in enumerate(texts):
            if len(t) < LEAST_WORDS:
                self.short.setdefault(len(t), {}).setdefault(tuple(t), []).append(j)
                continue
            step = STEP
            while len(t) >= (STEP_WORDS if step == STEP else STEP_WORDS * step):
                step *= 4
            by_step.setdefault(step, []).append(j)
        #: Bits of each item's words, and how many of them a leak shows at least.
        self.signatures = self.signed(rows.none, [list({rows[w] for w in d} - {rows.none}) for d in self.sets])
        self.least_bits = np.ceil(self.least).astype(int) - [len(d) for d in self.sets] + np.bitwise_count(self.signatures).sum(1, dtype=int)
        #: (step, items, their vectors, reach): items are searched in windows that fit their length.
        self.scales = []
        for step, own in sorted(by_step.items()):
            items = np.stack([self.vectors[[rows[w] for w in texts[j]]].sum(0) for j in own])
            items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)
            self.scales.append((step, np.array(own), items, max(len(texts[j]) for j in own) // 2))

    @staticmethod
    def signed(none: int, at: list[list[int]] | np.ndarray) -> np.ndarray:
        """The signatures of lists of rows (or of the lines of a matrix of rows)."""
        bits = np.zeros((len(at), SIGNATURE + 1), dtype=bool)
        if isinstance(at, np.ndarray):
            bits[np.arange(len(at))[:, None], np.where(at == none, SIGNATURE, at % SIGNATURE)] = True
        else:
            for i, row in enumerate(at):
                bits[i, np.array(row, dtype=np.int64) % SIGNATURE] = True
        return np.packbits(bits[:, :SIGNATURE], axis=1).view(np.uint64)

    def near_items(self, at: np.ndarray, begin: int, stop: int, step: int, reach: int) -> dict[int, np.ndarray]:
        """By width, for the windows from the steps of at[begin:stop]: the signature of all steps that `reach` words around one touch."""
        around = -(-reach // step)
        low, high = max(0, begin // step - around), min(len(at) // step, -(-stop // step) + around)
        steps = self.signed(len(self.vectors) - 1, at[low * step : high * step].reshape(-1, step))
        steps = np.pad(steps, ((around - (begin // step - low), around + max(WIDTHS)), (0, 0)))
        out = {}
        for width in WIDTHS:
            n = len(steps) - 2 * around - width + 1
            out[width] = np.bitwise_or.reduce([steps[i : i + n] for i in range(2 * around + width)])
        return out

    def sharing(self, signatures: np.ndarray, places: np.ndarray, items: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """Which pairs of places and items may share as many words as a leak does; none that does is left out."""
        out = [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(places), chunk):
            own = items[a : a + chunk]
            shared = np.bitwise_count(signatures[places[a : a + chunk]] & self.signatures[own]).sum(1, dtype=int)
            out.append(a + np.flatnonzero(shared >= self.least_bits[own]))
        return np.concatenate(out)

    def windows(self, at: np.ndarray, step: int, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(step, item, cosine, width) of all windows whose cosine reaches the threshold. at: rows of words, in whole steps."""
        steps = self.vectors[at].reshape(-1, step, self.vectors.shape[1]).sum(1)
        for width in WIDTHS:
            n = len(steps) - width + 1
            if n <= 0:
                continue
            sums = sum(steps[i : i + n] for i in range(width))
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            live = np.flatnonzero(size[:, 0] > 0)
            for a in range(0, len(live), 4096):
                some = live[a : a + 4096]
                near = (sums[some] / size[some]) @ items.T
                i, j = np.nonzero(near >= self.rules.cosine)
                yield some[i], j, near[i, j], width

    def verify(self, item: int, text: list[bytes], start: int, stop: int) -> tuple[float, float] | None:
        """(share of the item's words in order, share of the answer's) if the place in the text is a leak."""
        own, rules = self.texts[item], self.rules
        region = text[max(0, start - len(own) // 2) : stop + len(own) // 2]
        share = lcs_length(own, region) / len(own)
        if share < rules.paraphrase:
            return None
        tail = own[-max(1, round(len(own) * rules.answer_part)) :]
        answer = lcs_length(tail, region) / len(tail)
        return (share, answer) if share >= rules.lcs or answer >= rules.answer else None

    def search(self, texts: list[bytes | None], words_at_once: int = 1 << 16) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, lcs, answer) of each leak, once for each text and item."""
        if self.rows is None:
            self.rows = Buckets(self.live)
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for i, text in enumerate(texts):
            if split := words(text):
                held.append((i, split))
                size += len(split) + 64
                for n, known in self.short.items():
                    for j in {j for gram in set(zip(*(split[k:] for k in range(n)), strict=False)) for j in known.get(gram, ())}:
                        yield i, j, 1.0, 1.0, 1.0
            if size >= words_at_once:
                yield from self._search(held)
                held, size = [], 0
        if held:
            yield from self._search(held)

    def _search(self, held, piece: int = 1 << 18):
        rows, sets, least = self.rows, self.sets, self.least
        none = rows.none
        found = [list(map(rows.__getitem__, split)) for _, split in held]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for step, own, items, reach in self.scales:
            overlap = step * (max(WIDTHS) - 1)
            at: list[int] = []
            first = []
            for row in found:
                first.append(len(at) // step)
                at += row
                at += [none] * (overlap + -len(row) % step)
            at_, first_, own_, own = np.array(at), np.array(first), own, own.tolist()
            whole = max(step, piece // step * step)
            for begin in range(0, len(at_), whole):
                signatures = self.near_items(at_, begin, min(len(at_), begin + whole + overlap), step, reach)
                for place_, item, cosine, width in self.windows(at_[begin : begin + whole + overlap], step, items):
                    some = self.sharing(signatures[width], place_, own_[item])  # most windows lack the words of an item
                    place_, item, cosine = place_[some], item[some], cosine[some]
                    place_ = place_ + begin // step
                    text = np.searchsorted(first_, place_, "right") - 1
                    start = (place_ - first_[text]) * step
                    place, near = None, frozenset()
                    for k, a, j, c in zip(text.tolist(), start.tolist(), item.tolist(), cosine.tolist(), strict=True):
                        j = own[j]
                        if (k, a) != place:  # windows come in order, each with all its items
                            place, split = (k, a), held[k][1]
                            near = frozenset(split[max(0, a - reach) : a + width * step + reach])
                        if len(near & sets[j]) < least[j]:
                            continue
                        i = held[k][0]
                        known = best.get((i, j))
                        if known and known[1] == 1.0:
                            continue
                        checked = self.verify(j, split, a, a + width * step)
                        if checked and (known is None or (checked[0], c) > (known[1], known[0])):
                            best[i, j] = (c, *checked)
        for (i, j), (c, share, answer) in best.items():
            yield i, j, c, share, answer


def latent_space(docs: DataFrame, items: DataFrame, text: str, rules: Rules) -> tuple[np.ndarray, np.ndarray] | None:
    """(live buckets, their weighted vectors) of one space for all items: frequencies cover all documents, the space is that of the items' TF-IDF vectors."""
    live = live_buckets(items)
    if not len(live):
        return None
    df, n = document_frequencies(docs, text, live)
    weights = np.log((1 + n) / (1 + df)) + 1e-3
    rows = kept(passages(items, live, weights), "passages")
    space = randomised_svd(rows, len(live), min(rules.rank, len(live)))
    return live, (weights[:, None] * space).astype(np.float32)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", rules: Rules = Rules()) -> DataFrame:
    """(key, item, cosine, lcs, answer): one row for each document and benchmark item that it holds, verbatim or reworded.

    Words are runs of ASCII letters, digits and other bytes, ASCII letters lower-cased. Every window of every whole
    document is projected into one latent space and compared with all items; windows of a cosine of at least
    rules.cosine are checked by their longest common subsequence with the item and by the item's last words, its
    answer. Windows fit the items' lengths. Items of fewer than five words are found word for word. Items are searched
    in blocks of a fixed number, so what is broadcast is bounded; the space does not depend on the blocks. Null and
    empty texts hold nothing, items without a word are nowhere; repeated rows give one row for each key; items of
    equal text are found each; an empty table of either kind gives an empty result.
    """
    tune(docs.sparkSession)
    spark = docs.sparkSession
    kinds = (docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    columns = f"key {kinds[0]}, item {kinds[1]}, cosine double, lcs double, answer double"
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    id_type = to_arrow_type(benchmark.schema[item].dataType)
    parts: list[DataFrame] = []

    items = benchmark.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
    space = latent_space(source, items.select("t"), "text", rules)
    live, vectors = space or (np.zeros(0, np.int64), np.zeros((0, 1), np.float32))

    def search(block: list[tuple]) -> None:
        shipped = spark.sparkContext.broadcast(Index([i for i, _ in block], [t for _, t in block], live, vectors, rules))

        def run(batches):
            import pyarrow as pa

            trim()
            index = shipped.value
            for batch in batches:
                found = list(index.search(batch.column(1).to_pylist()))
                rows = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                ids = pa.array([index.ids[f[1]] for f in found], id_type)
                yield pa.RecordBatch.from_arrays([rows, ids, *[pa.array([float(f[n]) for f in found], pa.float64()) for n in (2, 3, 4)]], names=["key", "item", "cosine", "lcs", "answer"])

        parts.append(kept(source.mapInArrow(run, columns), "leaks"))
        shipped.unpersist()

    block: list[tuple] = []
    for r in items.orderBy("i", "t").toLocalIterator():
        own = words(bytes(r["t"]) if r["t"] else None)
        if own:
            block.append((r["i"], own))
        if len(block) == rules.items_at_once:
            search(block)
            block = []
    if block:
        search(block)
    found = parts[0] if parts else spark.createDataFrame([], columns)
    for more in parts[1:]:
        found = found.unionByName(more)
    found = found.groupBy("key", "item").agg(F.max(F.struct("lcs", "cosine", "answer")).alias("b"))
    return found.select(F.col("key").alias(key), F.col("item").alias(item), F.col("b.cosine").alias("cosine"), F.col("b.lcs").alias("lcs"), F.col("b.answer").alias("answer"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null key are judged by their own text too."""
    gone = find_leaks(docs, benchmark, key, text).select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["__gone"]), "left_anti")
