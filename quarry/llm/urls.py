"""URL filter: host and path rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import letters_lower, tune

#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with its path.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ://, A-Z lower-cased; empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = letters_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def features(url: str | None, suffixes: dict[str, float], prior: float) -> list[float]:
    """Length, host length, labels, depth, digit ratio, entropy, hyphens, parameters, fragment, and the block rates of two suffixes."""
    url = url or ""
    rest = url.partition("://")[2]
    host, path, query, mark = re.match(r"([^/?#]*)([^?#]*)(\??[^#]*)(#?)", rest).groups()
    host = host.lower()
    n = max(1, len(url))
    counts = Counter(url)
    entropy = math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n
    labels = host.split(".")
    return [len(url), len(host), len(labels), path.count("/"), sum(counts[d] for d in "0123456789") / n, entropy, host.count("-"), query.count("=") + query.count("&"), float(bool(mark)), suffixes.get(labels[-1], prior), suffixes.get(".".join(labels[-2:]), prior)]


@dataclass
class Trees:
    """Boosted regression trees on logistic loss, over quantile bins."""

    suffixes: dict[str, float]
    prior: float
    start: float = 0.0
    rate: float = 0.2
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def matrix(self, urls: list) -> np.ndarray:
        return np.array([features(u, self.suffixes, self.prior) for u in urls], dtype=float).reshape(len(urls), 11)

    @staticmethod
    def fit(urls: list[str], labels: list[int], count: int = 60, depth: int = 3, bins: int = 32, most_suffixes: int = 2000) -> Trees:
        y = np.array(labels, dtype=float)
        prior = float(y.mean()) if len(y) else 0.0
        seen: dict[str, list[float]] = {}
        for u, label in zip(urls, labels, strict=True):
            host = re.match(r"[^/?#]*", u.partition("://")[2])[0].lower().split(".")
            for s in {host[-1], ".".join(host[-2:])}:
                got = seen.setdefault(s, [0, 0])
                got[0] += label
                got[1] += 1
        top = sorted(seen, key=lambda s: (-seen[s][1], s))[:most_suffixes]
        model = Trees({s: (seen[s][0] + 10 * prior) / (seen[s][1] + 10) for s in top}, prior)
        if not 0 < prior < 1:
            model.start = 20.0 if prior else -20.0
            return model
        model.start = math.log(prior / (1 - prior))
        x = model.matrix(urls)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        score = np.full(len(y), model.start)
        for _ in range(count):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=int)
            inner = (1 << depth) - 1
            split_on, split_at = np.zeros(inner, dtype=int), np.full(inner, np.inf)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                best = (1e-6, 0, 0)
                if len(rows) >= 20:
                    for f, e in enumerate(edges):
                        gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))
                        hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))
                        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
                if best[0] > 1e-6:
                    split_on[at], split_at[at] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * at + 1 + (x[rows, split_on[at]] > split_at[at])
            leaf = node - inner
            values = np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
            model.trees.append((split_on, split_at, values))
            score += model.rate * values[leaf]
        return model

    def predict(self, urls: list) -> np.ndarray:
        """The probability that a URL is to be blocked."""
        x = self.matrix(urls)
        score = np.full(len(x), self.start)
        for on, at, values in self.trees:
            node = np.zeros(len(x), dtype=int)
            while len(x) and node[0] < len(on):
                node = 2 * node + 1 + (x[np.arange(len(x)), on[node]] > at[node])
            score += self.rate * values[node - len(on)]
        return 1 / (1 + np.exp(-score))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score): verdict is the rule's, else that of the trees (block from the threshold on).

    The trees learn from URLs that a rule labels, in a sample of about `sample` of them that a hash of the URL
    draws. With no labelled URL all others are allowed. A null URL has empty parts and is judged like an empty one. Repeated rows get
    equal results; columns that are not named are not read.
    """
    spark = pages.sparkSession
    tune(spark)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    labelled = rows.where("ruled is not null")
    n = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1_000_000)) < min(1.0, sample / max(n, 1)) * 1_000_000)
    drawn = sorted((r["url"], int(r["ruled"] == "block")) for r in drawn.select("url", "ruled").toLocalIterator())
    shipped = spark.sparkContext.broadcast(Trees.fit([d[0] for d in drawn], [d[1] for d in drawn]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = shipped.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, url string, host string, path string, rule string, ruled string, score double")
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
