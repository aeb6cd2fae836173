"""Bootstrapped contexts: unseen identifiers in two rounds, precision and recall on a planted corpus, plain version of the loop."""

import random

from quarry.llm import pii

KIND = {k: i for i, k in enumerate(pii.KINDS)}


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.pii_spans(df).collect()}


def test_identifiers_are_found_in_two_rounds(spark):
    """Seeds teach `mailbox`; what follows it there teaches `desk`, which finds an identifier that no seed has for a neighbour."""
    texts = [f"write to mailbox user{i}@host{i}.example.com today" for i in range(60)]
    texts += [f"old mailbox clerk{i}@intranet closed" for i in range(8)] + [f"ask desk clerk{i}@intranet first" for i in range(8)]
    texts += ["ask desk porter@vault, first", "the number 1234567 is none", "", None]
    got = spans_of(spark, texts)
    assert all(got[i] == f"email:17:{17 + len(f'user{i}@host{i}.example.com')}" for i in range(60))
    assert [got[60 + i] for i in range(16)] == ["email:12:27"] * 8 + ["email:9:24"] * 8
    assert [got[76 + i] for i in range(4)] == ["email:9:21", "", "", ""]


def test_precision_and_recall_on_a_planted_corpus(spark):
    rng = random.Random(6)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gorse", "hazel", "ivy", "juniper"]
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts, hidden = [], {}
    for i in range(1500):
        text = " ".join(rng.choices(words, k=rng.randint(3, 12)))
        what = rng.random()
        if what < 0.3:
            text += f" call +1 ({number(3)}) 555-{number(4)} now"
        elif what < 0.33:
            found = f"({number(3)}) 555-{number(4)}"
            hidden[i] = (len(text) + 7, len(text) + 6 + len(found))
            text += f" call {found} now"
        elif what < 0.6:
            text += f" part {number(8)} in " + rng.choice(words)
        elif what < 0.7:
            text += f" part +1 ({number(3)}) 555-{number(4)} in"
        texts.append(text + " " + rng.choice(words))
    got = spans_of(spark, texts)
    right = sum(got[i] == f"phone:{a}:{b}" for i, (a, b) in hidden.items())
    added = sum(got[i] != "" for i in range(1500) if "+1" not in texts[i])
    assert right >= 0.95 * len(hidden) and right >= 0.95 * added


def test_loop_equals_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 120), rng.choice("@9a"), [(rng.randint(0, 2), f"w{rng.randint(0, 14)}") for _ in range(rng.randint(0, 3))]) for _ in range(500)]
    chars = {v: c for v, c, _ in rows}
    kind = {v: (v % 2 if v < 70 else -1) for v in chars}
    units = [(v, chars[v], kind[v], p) for v, _, p in rows]
    df = spark.createDataFrame(units, "value long, chars string, k int, patterns array<struct<side:int,words:string>>")
    got = {r["value"]: (r["k"], r["round"], round(r["score"], 9)) for r in pii.bootstrap(df, confident=0.8).collect()}
    under = {}
    for v, _, _, ps in units:
        for p in ps:
            under.setdefault(p, set()).add(v)
    labels = {v: (kind[v], 0, 1.0) for vs in under.values() for v in vs if kind[v] >= 0}
    classes = {(kind[v], chars[v]) for vs in under.values() for v in vs if kind[v] >= 0}
    for i in range(1, 11):
        scores = {}
        for vs in under.values():
            known = [labels[v] for v in vs if v in labels]
            for k in (0, 1):
                gained = sum(s for kk, _, s in known if kk == k)
                confidence = gained / (len(known) + pii.DOUBT * (len(vs) - len(known)))
                if gained >= pii.SUPPORT * 0.8 and confidence >= pii.LEAST:
                    for v in vs - labels.keys():
                        if (k, chars[v]) in classes:
                            scores.setdefault(v, {}).setdefault(k, []).append(confidence)
        new = {}
        for v, by_kind in scores.items():
            best = max(((1 - __import__("math").prod(max(1 - c, 1e-9) for c in cs)), -k) for k, cs in by_kind.items())
            if best[0] >= 0.8:
                new[v] = (-best[1], i, best[0])
        if not new:
            break
        labels |= new
    want = {v: (k, i, round(s, 9)) for v, (k, i, s) in labels.items() if i}
    assert want and got == want
