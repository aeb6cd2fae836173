"""Secret scans: entropy spans against a plain version, planted secrets, long candidates and clashing names."""

import math
import random
import re
import string
import time
from collections import Counter

import brute
from pyspark.sql import functions as F

from quarry.llm import secrets

ALPHABETS = [string.hexdigits[:16], string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]


def entropy(s, window=secrets.WINDOW):
    return max((math.log2(window) - sum(c * math.log2(c) for c in Counter(s[i : i + window]).values()) / window for i in range(len(s) - window + 1)), default=0.0)


def high(s):
    needed = next(least for pattern, least in secrets.CLASSES if re.search(pattern, s))
    return not any(re.search(p, s) for p in secrets.ALLOW) and entropy(s) >= needed - 1e-12


def plain_spans(text):
    found = brute.base(text, brute.SECRETS, False)[2]
    runs = [(3, m.start(), m.end()) for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text or "") if high(m[0])]
    found = found + [r for r in runs if not any(a < r[2] and r[1] < b for _, a, b in found)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], x[0], x[2])))


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in secrets.secret_spans(df).collect()}


def test_all_spans_equal_the_plain_version(spark):
    rng = random.Random(3)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = [" ".join(rng.choice([word("abcde", 4), word(ALPHABETS[2], 24), word(ALPHABETS[0], 26), word("0123456789", 22), word(string.ascii_letters, 25), "é", "token = " + word(ALPHABETS[1], 30), "test-" + word(ALPHABETS[2], 20), word("ab", 40)]) for _ in range(30)) for _ in range(30)]
    got = spans_of(spark, [*texts, "", None])
    assert [got[i] for i in range(32)] == [plain_spans(t) for t in [*texts, "", None]]


def test_recall_and_false_alarms(spark):
    """Random keys in prose are found, prose, paths, dates and identifiers are not."""
    rng = random.Random(8)
    keys = ["".join(rng.choice(a) for _ in range(rng.randint(24, 40))) for a in ALPHABETS for _ in range(100)]
    prose = ["the committee discussed", "src/main/java/com/acme/util/StringHelper", "2024-01-02-17-45-00-report-final", "getUserAccountInformationService", "Donaudampfschifffahrtsgesellschaft", "--------------------------", "version-1.2.3-beta", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "incomprehensibilities"]
    got = spans_of(spark, [f"see {k} here" for k in keys] + prose)
    found = [i for i in range(len(keys)) if f":4:{4 + len(keys[i])}" in got[i]]
    assert len(found) >= 0.95 * len(keys)
    assert [got[len(keys) + i] for i in range(len(prose))] == [""] * len(prose)


def test_a_long_candidate_takes_time_in_proportion(spark):
    rng = random.Random(1)
    big = "".join(rng.choice(ALPHABETS[2]) for _ in range(1_000_000))
    spans_of(spark, ["warm " + big[:100]])
    began = time.perf_counter()
    assert spans_of(spark, ["é " + big]) == {0: "entropy:2:1000002"}
    assert time.perf_counter() - began < 60


def test_redaction_keeps_other_columns(spark):
    text = "é token = 0123456789abcdef0123456789abcdef end Zk3vQ9xT1mB7nW2pL5rC8sD4"
    rows = [(0, text, 7, 8, 1.5, "x"), (0, text, 7, 8, 1.5, "x"), (1, "clean", 1, 2, 0.5, "y"), (2, None, 1, 2, 0.5, "z"), (3, "", 1, 2, 0.5, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int, more int, `a.b` double, __all string")
    out = secrets.redact_secrets(df)
    assert out.columns == df.columns
    new = "é [SECRET] end [SECRET]"
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((*r[:1], new if r[1] == text else r[1], *r[2:]) for r in rows), key=str)
    assert secrets.redact_secrets(df.limit(0)).count() == 0


def test_short_values_have_no_window(spark):
    df = spark.createDataFrame([("",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(secrets.window_entropy(F.col("v"))).collect()][:2] == [0.0, 0.0]
