"""Secret scans with built-in functions only: fixed patterns, and entropy in a sliding window over candidate strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import spans as S
from quarry.llm.shared import named

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Candidate strings: a whole run of these characters, at least as long as the window.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Least entropy in bits over the best window of 20 characters (4.32 at most), by the characters that the candidate
#: holds: digits (3.32 at most), hexadecimal digits (4 at most), letters of one case, letters, letters of one case
#: with digits, all else. Runs without a digit need more, as long words and names are varied too.
CLASSES = [("^[0-9]+$", 3.25), ("^[0-9a-f]+$|^[0-9A-F]+$", 3.0), ("^[a-z]+$|^[A-Z]+$", 4.15), ("^[A-Za-z]+$", 4.1), ("^[a-z0-9]+$|^[A-Z0-9]+$", 3.5), ("^[^0-9]+$", 4.1), ("", 3.7)]
#: Forms that are long and varied but no secrets. Words count only as whole segments.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(?<![a-z0-9])(?:example|sample|test|dummy|placeholder|lorem)(?![a-z0-9])",
    r"(?i)0123456789|123456789|abcdefghij|qwertyuiop",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$",
    r"^(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))+[-_/=+]*$",
]


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The most Shannon entropy (bits a character) that any whole window of the string has; 0 for a shorter string.

    Counts move with the window: one character leaves, one enters, and the sum of c log2 c changes by those two
    counts alone, which the window itself holds. The work is the length times the window's; the characters are
    split once and bound to a lambda variable.
    """
    grows = F.array(*[F.lit((c + 1) * _log2(c + 1) - c * _log2(c)) for c in range(window + 1)])

    def best(chars: Column) -> Column:
        def count(i, first, n):
            return F.size(F.filter(F.slice(chars, first + 1, n), lambda c: c == F.get(chars, i)))

        def step(state, i):  # each state has the sum after its own character, and the least sum before it
            leaves = F.get(grows, count(i - window, i - window, F.lit(window)) - 1)
            enters = F.get(grows, count(i, F.greatest(i - window + 1, F.lit(0)), F.least(i, F.lit(window - 1))))
            total = F.when(i >= window, state["total"] - leaves).otherwise(state["total"]) + enters
            least = F.when(i >= window, F.least(state["least"], state["total"])).otherwise(state["least"])
            return F.struct(total.alias("total"), least.alias("least"))

        begin = F.struct(F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, lambda s: F.lit(_log2(window)) - F.least(s["least"], s["total"]) / window)

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.when(F.length(value) < window, F.lit(0.0)).otherwise(F.get(F.transform(F.array(chars), best), 0))


def _log2(x: float) -> float:
    import math

    return math.log2(x) if x else 0.0


def high_entropy(value: Column) -> Column:
    needed = F.lit(CLASSES[-1][1])
    for pattern, least in CLASSES[-2::-1]:
        needed = F.when(value.rlike(pattern), F.lit(least)).otherwise(needed)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(value) >= needed)


def scan_secrets(docs: DataFrame, text: str = "text", base: str = "base", more: str = "more") -> DataFrame:
    """docs with two columns added (any of their names are replaced): arrays of (k, start, stop), k being the place in KINDS.

    base: matches of the fixed patterns; more: candidate strings that overlap none of them, have a window of
    high entropy for their character class and are not on the allow-list. Positions are code points. A null or
    empty text has none; an empty table gives an empty one; repeated rows have equal spans; texts are scanned
    whole, and time is in proportion to their length, also within one long run. Columns __secret_* are reserved.
    """
    t, own = F.col(f"`{text}`"), lambda k: f"__secret_{k}"
    out = S.find(docs, own("assign"), text, ASSIGN, t.rlike("(?i:passw|secret|token|api_?key)"), group=2)
    out = S.find(out, own("access"), text, ACCESS, t.contains("AKIA"))
    out = S.find(out, own("hex"), text, HEX, t.rlike(HEX))
    out = S.find(out, own("run"), text, RUN, t.rlike(RUN))
    out = out.withColumn(own("assign"), F.filter(own("assign"), lambda s: F.length(s["part"]) >= 8))
    out = out.withColumn(own("base"), F.concat(*[S.of_kind(F.col(own(k)), i) for i, k in enumerate(KINDS[:3])]))
    high = F.filter(S.apart(F.col(own("run")), F.col(own("base"))), lambda s: high_entropy(s["hit"]))
    out = out.withColumn(own("more"), S.of_kind(high, 3)).drop(*map(own, (*KINDS[:3], "run")))
    for name, made in ((base, own("base")), (more, own("more"))):
        if name != made:
            out = out.drop(name).withColumnRenamed(made, name)
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    out = scan_secrets(docs.select("doc_id", "text"))
    counts = [S.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(S.joined(F.col("base"), KINDS, by_kind=False), 256).alias("base_sha256"), S.joined(F.concat("base", "more"), KINDS, by_kind=False).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by a mark; overlapping spans count as one. Null texts stay null, all other columns as they are."""
    out = scan_secrets(docs, text, "__secret_base", "__secret_more")
    spans = F.array_sort(F.transform(F.concat("__secret_base", "__secret_more"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    (t,) = named(text)

    def step(state, s):
        inside = s["start"] < state["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(t, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate(spans, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.length(t))))
    new = F.when(F.size("__secret_base") + F.size("__secret_more") > 0, new).otherwise(t)
    return out.select(*[new.alias(c) if c == text else own for c, own in zip(docs.columns, named(*docs.columns), strict=True)])
