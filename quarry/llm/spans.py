"""Spans of regular expressions in code points, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,hit:string,part:string,before:string,after:string>>"
#: Matches whose places are summed in one go; longer lists are summed by blocks, so the work stays linear.
BLOCK = 256


def find(df: DataFrame, name: str, text: str, pattern: str, only: Column, group: int = 0, sides: bool = False) -> DataFrame:
    """Add column `name`: all leftmost non-overlapping matches in `text` where `only` holds, else none.

    Each has start and stop in code points, hit, part (a group) and, with sides, the text before and after it
    up to the next match. The text between the matches comes from split(), so starts are running sums of
    lengths. A null text has no matches.
    """
    t, rows = F.col(f"`{text}`"), f"__{name}_rows"
    gaps, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 0)
    gone = F.lit(None).cast("string")
    made = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"), h.alias("part"), gone.alias("after")))
    if group:
        parts = F.regexp_extract_all(t, F.lit(pattern), group)
        made = F.zip_with(made, parts, lambda x, p: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), p.alias("part"), x["after"].alias("after")))
    if sides:
        made = F.zip_with(made, F.slice(gaps, 2, (1 << 31) - 1), lambda x, a: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["part"].alias("part"), a.alias("after")))
    made = F.when(only, F.filter(made, lambda x: x["hit"].isNotNull()))
    df = df.withColumn(rows, made)
    empty = F.array().cast(SPAN)

    def shifted(span, by):
        return F.struct((span["start"] + by).alias("start"), (span["stop"] + by).alias("stop"), span["hit"].alias("hit"), span["part"].alias("part"), span["before"].alias("before"), span["after"].alias("after"))

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit"), x["part"].alias("part"), (x["gap"] if sides else gone).alias("before"), x["after"].alias("after"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def within(block):
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def over(state, x):
        moved = F.transform(x["out"], lambda s: shifted(s, state["at"]))
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    n = F.size(rows)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: within(F.slice(F.col(rows), b * BLOCK + 1, BLOCK)))
    found = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), over, lambda state: F.flatten(state["out"]))
    return df.withColumn(name, F.when(n > 0, found).otherwise(empty)).drop(rows)


def joined(spans: Column, order: list[str], by_kind: bool) -> Column:
    """kind:start:end, comma-joined; spans are structs of k (the kind's number), start and stop."""
    names = F.array(*map(F.lit, order))
    key = (lambda s: (s["k"], s["start"], s["stop"])) if by_kind else (lambda s: (s["start"], s["k"], s["stop"]))
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(key(s)[0].alias("a"), key(s)[1].alias("b"), key(s)[2].alias("c"))))
    kind, start = ("a", "b") if by_kind else ("b", "a")
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(names, s[kind]), s[start].cast("string"), s["c"].cast("string"))), ",")


def of_kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["stop"].alias("stop")))


def apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])))


def count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")
