"""Personal data with built-in functions only: fixed patterns as seeds, and contexts bootstrapped from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import spans as S
from quarry.llm.shared import kept, letters_lower

KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A whole chain of digits that single blanks or hyphens may part, if it has 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidate identifiers: numbers that single blanks part, or else words that hold a digit or an at sign.
UNIT = r"(?<![^\x20\x09-\x0D])(?:[(+]*+[0-9][0-9().+/-]*+(?:\x20[(+]?[0-9][0-9().+/-]*+)*+[,;:!?]*+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Fewer digits without an at sign make no identifier.
DIGITS = 6

#: Rounds at most; instances that a pattern needs; what an instance without a kind counts against a pattern; confidence
#: that a pattern needs to say anything; score from which an instance is an identifier.
ROUNDS = 10
SUPPORT = 5
DOUBT = 0.5
LEAST = 0.5
CONFIDENT = 0.9


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s["hit"], "[^0-9]", "")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` added: an array of (k, start, stop), k being the place in KINDS."""
    t = F.col(text)
    out = S.find(docs, "__email", text, EMAIL, t.contains("@"))
    out = S.find(out, "__ip", text, IP, t.rlike(IP))
    out = S.find(out, "__card", text, CARD, t.rlike(CARD))
    out = S.find(out, "__phone", text, PHONE, t.contains("+"))
    checks = {
        "ip": lambda s: s["hit"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda s: luhn(_digits(s)),
        "phone": lambda s: F.length(_digits(s)).between(8, 15),
    }
    for kind, check in checks.items():
        out = out.withColumn(f"__{kind}", F.filter(f"__{kind}", check))
    return out.withColumn("base", F.concat(*[S.of_kind(F.col(f"__{k}"), i) for i, k in enumerate(KINDS)])).drop(*[f"__{k}" for k in KINDS])


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with `units` added: candidates with their place, value, class of characters, the kind of a seed in them (-1: none) and patterns.

    A pattern is a side (0: the word before, 1: the two words before, 2: the word after) and those words.
    """
    out = S.find(docs, "__units", text, UNIT, F.col(f"`{text}`").rlike("[0-9@]"), sides=True)
    word = r"[^\x20\x09-\x0D]{1,40}+"

    def context(side: int, found):
        words = letters_lower(F.regexp_replace(F.regexp_replace(found, r"[\x20\x09-\x0D]+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        return F.struct(F.lit(side).alias("side"), words.alias("words"))

    def unit(s):
        lead = F.length(F.regexp_extract(s["hit"], r"^[^\p{L}\p{N}+]*+", 0))
        value = F.regexp_replace(F.substring(s["hit"], lead + 1, F.length(s["hit"])), r"[^\p{L}\p{N}]++$", "")
        start = s["start"] + lead
        before, after = F.substring(s["before"], -100, 100), F.substring(s["after"], 1, 100)
        patterns = F.array(
            context(0, F.regexp_extract(before, rf"(?<![^\x20\x09-\x0D])({word})[\x20\x09-\x0D]*+$", 1)),
            context(1, F.regexp_extract(before, rf"(?<![^\x20\x09-\x0D])({word}[\x20\x09-\x0D]++{word})[\x20\x09-\x0D]*+$", 1)),
            context(2, F.regexp_extract(after, rf"^[\x20\x09-\x0D]*+({word})", 1)),
        )
        kind = F.coalesce(F.get(F.filter("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])), 0)["k"], F.lit(-1))
        kinds = F.when(F.contains(value, F.lit("@")), "@").when(value.rlike(r"\p{L}"), "a").otherwise("9")
        enough = F.contains(value, F.lit("@")) | (F.length(F.regexp_replace(value, "[^0-9]+", "")) >= DIGITS)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), F.xxhash64(letters_lower(value)).alias("value"), kinds.alias("chars"), kind.alias("k"), F.filter(patterns, lambda p: p["words"].rlike(r"\p{L}")).alias("patterns"), enough.alias("enough"))

    return out.withColumn("units", F.filter(F.transform("__units", unit), lambda u: u["enough"])).drop("__units")


def bootstrap(units: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(value, k, score, round): identifiers that no fixed pattern has, from units (value, chars, k, patterns).

    Seeds are the values of a kind. In each round the labelled values induce patterns from all their contexts: a
    pattern's confidence for a kind is what its labelled values score in that kind, over all its labelled values
    and DOUBT times the others. A value without a kind scores 1 - the product of (1 - confidence) over its
    patterns; from `confident` on it is promoted, so that its other contexts induce patterns in the next round. It ends
    when a round promotes none. A value must have characters of a class that the kind's seeds have. Edges of the
    graph are the different pairs of pattern and value, counted before any join, so a frequent one is one row.
    """
    edges = kept(units.select("value", "chars", "k", F.explode("patterns").alias("p")).groupBy("p", "value", "chars").agg(F.max("k").alias("k")), "pii-edges")
    totals = kept(edges.groupBy("p").agg(F.count("*").alias("total")), "pii-totals")
    classes = {(r["k"], r["chars"]) for r in edges.where("k >= 0").select("k", "chars").distinct().collect()}  # as many as kinds and classes at most
    labels = kept(edges.where("k >= 0").groupBy("value").agg(F.min("k").alias("k")).select("value", "k", F.lit(1.0).alias("score"), F.lit(0).alias("round")), "pii-labels")
    fits = F.lit(False)
    for k, chars in sorted(classes):
        fits = fits | ((F.col("k") == k) & (F.col("chars") == chars))
    for i in range(1, rounds + 1):
        gained = edges.select("p", "value").join(labels.select("value", "k", "score"), "value").groupBy("p", "k").agg(F.sum("score").alias("gained"), F.count("*").alias("n"))
        labelled = edges.select("p", "value").join(labels.select("value"), "value").groupBy("p").agg(F.count("*").alias("labelled"))
        patterns = gained.where(F.col("gained") >= support * F.lit(confident)).join(labelled, "p").join(totals, "p")
        patterns = patterns.select("p", "k", (F.col("gained") / (F.col("labelled") + DOUBT * (F.col("total") - F.col("labelled")))).alias("confidence")).where(F.col("confidence") >= LEAST)
        unseen = edges.where("k < 0").select("p", "value", "chars").join(labels.select("value"), "value", "left_anti")
        scored = unseen.join(patterns, "p").where(fits).groupBy("value", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b")).where(F.col("b.score") >= confident)
        new = kept(best.select("value", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score"), F.lit(i).alias("round")), "pii-new")
        if new.isEmpty():
            break
        labels = kept(labels.unionByName(new), "pii-labels")
    return labels.where("round > 0")


def extract_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, more): arrays of (k, start, stop), k being the place in KINDS; positions are code points.

    base: matches of the fixed patterns. more: every place of the identifiers that bootstrap() finds, where no base
    span lies. A null or empty text has none; texts are scanned whole, whatever their length. Equal rows have equal
    results and each a row; a null key is kept; an empty table gives an empty one. Extra columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = _candidates(base_spans(rows, "text"), "text")
    row = F.struct(F.xxhash64("key", "text").alias("a"), F.hash("text", "key").alias("b"))
    found = kept(rows.select("key", row.alias("row"), "base", "units"), "pii-spans")
    units = found.select("row", F.explode("units").alias("u")).select("row", "u.*")
    new = units.where("k < 0").join(bootstrap(units).select("value", F.col("k").alias("kind")), "value")
    new = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("kind").alias("k"), "start", "stop"))).alias("more"))
    out = found.select("key", "row", "base").join(new, "row", "left")
    return out.select(F.col("key").alias(key), "base", F.coalesce("more", F.array().cast("array<struct<k:int,start:int,stop:int>>")).alias("more"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    out = extract_pii(docs)
    counts = [S.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(S.joined(F.col("base"), KINDS, by_kind=True), 256).alias("base_sha256"), S.joined(F.concat("base", "more"), KINDS, by_kind=True).alias("spans"))
