"""Language identification by prediction by partial matching over bytes, under frozen statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import named, trim, tune

ORDER = 3


#: Raw grams are three context bytes (MARK before the text's start) and the next byte.
MARK = 256


def raw_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) over all bytes of the texts; a gram is its three context symbols in base 257, then the byte."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text in texts:
        padded = np.full(len(text) + ORDER, MARK, dtype=np.int64)
        padded[ORDER:] = np.frombuffer(text, dtype=np.uint8)
        for at in range(0, len(text), 1 << 20):
            n = min(1 << 20, len(text) - at)
            key = np.zeros(n, dtype=np.int64)
            for back in range(ORDER):
                key = key * (MARK + 1) + padded[at + back : at + back + n]
            k, c = np.unique(key * MARK + padded[at + ORDER : at + ORDER + n], return_counts=True)
            keys.append(k)
            counts.append(c)
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64)


class ByteTrees:
    """Per language a context tree of up to three bytes, frozen into code lengths.

    In a context seen n times with q distinct next bytes, a byte seen c times has probability c / (n + q);
    the escape has q / (n + q) and goes to the context that is one byte shorter, without the bytes already
    excluded; below the empty context all 256 bytes are alike. The most frequent contexts have a row each in one
    dense table of table_bytes; all others have their seen bytes and their escape in sorted lists, so every
    context counts, whatever the number of languages and bytes. `row` leads from any three bytes to the row of
    their longest suffix in the table, negative where a longer one is in the lists.
    """

    def __init__(self, samples: dict[str, list[bytes] | tuple[np.ndarray, np.ndarray]], table_bytes: int = 24 << 20):
        """samples: texts, or their raw grams, of each language."""
        raw = {lang: x if isinstance(x, tuple) else raw_grams(x) for lang, x in samples.items()}
        self.langs = sorted(raw)
        seen = np.unique(np.concatenate([k % MARK for k, _ in raw.values()] or [np.zeros(0, np.int64)]))
        self.symbol = np.full(256, len(seen), dtype=np.uint8)  # the last symbol stands for all other bytes
        self.symbol[seen] = np.arange(len(seen))
        self.width = a = len(seen) + 1
        self.base = s = a + 1  # and one more, as context only, for what precedes a text
        grams = {lang: self._orders(*raw[lang]) for lang in self.langs}
        most = max(1, table_bytes // (4 * a * max(1, len(self.langs))))
        kept, cold = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n in range(1, ORDER + 1):
            keys = np.concatenate([g[n][0] // a for g in grams.values()] or [np.zeros(0, np.int64)])
            counts = np.concatenate([g[n][1] for g in grams.values()] or [np.zeros(0, np.int64)])
            contexts, total = _summed(keys, counts)
            room = max(0, most - sum(map(len, kept)))
            place = np.lexsort((contexts, -total))
            hot = place if n == 1 else place[:room]  # shorter contexts first: the suffix of a row has a row
            kept.append(np.sort(contexts[hot]))
            cold.append(np.setdiff1d(contexts, kept[n], assume_unique=True))
        start = np.cumsum([0, *map(len, kept)])
        index = [np.zeros(1, dtype=np.int32)]
        for n in range(1, ORDER + 1):
            full = np.broadcast_to(index[-1], (s, len(index[-1]))).reshape(-1).copy()
            full[kept[n]] = np.arange(start[n], start[n + 1])
            full[cold[n]] = np.where(full[cold[n]] < 0, full[cold[n]], -1 - full[cold[n]])
            index.append(full)
        self.row = index[ORDER].reshape(s, s, s)
        costs = np.zeros((start[-1], a, len(self.langs)), dtype=np.float32)
        for k, lang in enumerate(self.langs):
            p = np.zeros((start[-1], a))
            for n in range(ORDER + 1):
                if n:
                    parent = p[index[n - 1][kept[n] % s ** (n - 1)]]
                else:
                    parent = np.full((1, a), 1 / 256)
                    parent[0, -1] = (256 - a + 1) / 256
                keys, counts = grams[lang][n]
                where = np.searchsorted(kept[n], keys // a)
                ok = (where < len(kept[n])) & (kept[n][np.minimum(where, len(kept[n]) - 1)] == keys // a) if len(kept[n]) else np.zeros(len(keys), bool)
                c = np.zeros((len(kept[n]), a))
                c[where[ok], (keys % a)[ok]] = counts[ok]
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                left = 1 - (parent * (c > 0)).sum(1, keepdims=True)
                rest = np.where(c > 0, 0, parent) / np.maximum(left, 1e-300)
                whole = (left <= 1e-12) | (kinds == a)  # nothing to escape to
                mixed = np.where(whole, c / np.maximum(total, 1), (c + kinds * rest) / np.maximum(total + kinds, 1))
                p[start[n] : start[n + 1]] = np.where(total > 0, mixed, parent)
            p[:, -1] /= 256 - a + 1
            costs[:, :, k] = -np.log2(np.maximum(p, 1e-30))
        self.costs = costs.reshape(len(costs) * a, len(self.langs))
        #: For each language and order: contexts in the lists, the cost of their escape, grams, their cost.
        self.lists: list[dict[int, tuple]] = [{} for _ in self.langs]
        for k, lang in enumerate(self.langs):
            for n in range(2, ORDER + 1):
                keys, counts = grams[lang][n]
                own = np.isin(keys // a, cold[n])
                if own.any():
                    self.lists[k][n] = self._listed(k, n, keys[own], counts[own], index[n - 1])

    def _orders(self, keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(context * width + symbol, count) for contexts of no to three symbols, from raw grams."""
        of = np.append(self.symbol, self.base - 1).astype(np.int64)
        out, key, rest = [_summed(of[keys % MARK], counts)], of[keys % MARK], keys // MARK
        for n in range(1, ORDER + 1):
            key = key + of[rest % (MARK + 1)] * self.base ** (n - 1) * self.width
            rest = rest // (MARK + 1)
            out.append(_summed(key, counts))
        return out

    def _listed(self, k: int, n: int, keys: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> tuple:
        contexts, at = np.unique(keys // self.width, return_inverse=True)
        suffix = keys // self.width % self.base ** (n - 1)
        below = self._cost(k, n - 1, suffix, keys % self.width, shorter[suffix])
        total, kinds = (np.bincount(at, weights=w, minlength=len(contexts)) for w in (counts, np.ones(len(keys))))
        left = 1 - np.bincount(at, weights=np.exp2(-below), minlength=len(contexts))
        whole = (left <= 1e-12) | (kinds == self.width)
        escape = np.where(whole, -np.log2(1e-30), -np.log2(kinds / (total + kinds) / np.maximum(left, 1e-300)))
        return contexts, escape, keys, -np.log2(counts / (total + np.where(whole, 0, kinds))[at])

    def _cost(self, k: int, n: int, context: np.ndarray, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Code lengths in language k of symbols after contexts of order n; row: what the index of order n says."""
        out, open_ = np.zeros(len(context)), np.ones(len(context), dtype=bool)
        for order in range(n, 1, -1):
            if order not in self.lists[k]:
                continue
            contexts, escape, grams, cost = self.lists[k][order]
            own = context % self.base**order
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            here = open_ & (contexts[at] == own)
            key = own * self.width + symbol
            place = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            hit = here & (grams[place] == key)
            out[hit] += cost[place[hit]]
            out[here & ~hit] += escape[at[here & ~hit]]
            open_ &= ~hit
        row = np.where(row < 0, -1 - row, row).astype(np.int64)
        out[open_] += self.costs[row[open_] * self.width + symbol[open_], k]
        return out

    def _symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with three leading start marks before each text, and each symbol's text (-1: a mark)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(sizes + ORDER) - sizes
        where = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = np.full(int((sizes + ORDER).sum()), self.base - 1, dtype=np.uint8)
        out[where] = self.symbol[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        return out, where

    def bits(self, texts: list[bytes], chunk: int = 1 << 19) -> np.ndarray:
        """The code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        if not texts or not self.langs:
            return out
        s, where = self._symbols(texts)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        for at in range(0, len(where), chunk):
            w, o = where[at : at + chunk], owner[at : at + chunk]
            row = self.row[s[w - 3], s[w - 2], s[w - 1]].astype(np.int64)
            rare = np.flatnonzero(row < 0)
            found = self.costs[np.where(row < 0, 0, row) * self.width + s[w]]
            if len(rare):
                v = w[rare]
                context = (s[v - 3].astype(np.int64) * self.base + s[v - 2]) * self.base + s[v - 1]
                for k in range(len(self.langs)):
                    found[rare, k] = self._cost(k, ORDER, context, s[v].astype(np.int64), row[rare])
            low = o[0]
            for k in range(len(self.langs)):
                part = np.bincount(o - low, weights=found[:, k])
                out[low : low + len(part), k] += part
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 400) -> ByteTrees:
    """Fit on a bounded sample of labelled rows: about per_lang texts of each language, all their bytes.

    The sample is drawn by a hash of the key, so it is the same in every run; a language with fewer rows
    gives all of them. Tasks count the grams of their rows; the driver receives the sums, at most one for each
    different run of four bytes and language. Rows with a null text or language teach nothing, an empty text
    neither; no rows at all give trees that know no language.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ByteTrees({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    drawn = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("sample")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def count(batches):
        import pyarrow as pa

        trim()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = raw_grams([value])
                held[name] = _summed(*(np.concatenate(x) for x in zip(held[name], new, strict=True))) if name in held else new
        for name, (keys, counts) in held.items():
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 100_000])], names=["lang", "gram", "n"])

    grams = rows.where(drawn).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = grams.column("lang").combine_chunks().dictionary_encode()
    which, keys, counts = names.indices.to_numpy(), grams.column("gram").to_numpy(), grams.column("n").to_numpy()
    return ByteTrees({name: _summed(keys[which == i], counts[which == i]) for i, name in enumerate(names.dictionary.to_pylist())})


def identify(docs: DataFrame, trees: ByteTrees, text: str = "text", most_bits: float | None = None, slack: float = 64.0, pred: str = "lang_pred", share: str = "score") -> DataFrame:
    """docs' columns with lang_pred and score (or the names given) added (columns of these names are replaced).

    lang_pred: the language of the shortest code, the first by name of equal ones; `und` with score 0 where the
    text is null or has no letter, or nothing was learned. score: that language's share of the likelihood.
    Texts are scored whole, whatever their length; rows are independent of each other.
    """
    tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    others = [c for c in docs.columns if c not in (pred, share)]

    def run(batches):
        import pyarrow as pa

        trim()
        trees = shipped.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            told = np.array([i for i, t in enumerate(texts) if trees.langs and t is not None and any(map(str.isalpha, t))], dtype=np.int64)
            known = [texts[i].encode() for i in told]
            bits = trees.bits(known)
            names, scores = [None] * len(texts), np.zeros(len(texts))
            if len(bits):
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                ok = np.ones(len(bits), bool) if most_bits is None else least <= most_bits * np.fromiter(map(len, known), np.float64, len(known)) + slack
                scores[told[ok]] = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)[ok]
                for i, k in zip(told[ok], best[ok], strict=True):
                    names[i] = trees.langs[k]
            out = [pa.array([n or "und" for n in names], pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[f"c{i}" for i in range(len(others))] + ["pred", "share"])

    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(named(*others))], named(text)[0].alias("__text"))
    schema = ", ".join([f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(others))] + ["pred string", "share double"])
    return source.mapInArrow(run, schema).toDF(*others, pred, share)


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo parts."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from documents outside fold 0 of 5, predicted for all.

    A null doc_id is in no fold: such a row teaches nothing and counts as not held out.
    """
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    trees = train(docs.where(fold("doc_id", 5) != 0))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), trees).select("doc_id", "held_out", "lang_pred", "score")
