"""Near-duplicates by similarity of shingles, against a plain comparison of all pairs."""

import random

import numpy as np

import corpus_pipeline
from quarry.llm import neardup


def _grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _texts():
    rnd, texts = random.Random(3), []
    for _ in range(20):
        words = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(300)) for _ in range(200)]
        texts.append(" ".join(words))
        for changes in (1, 3, 4, 6, 12):
            other = list(words)
            for i in rnd.sample(range(200), changes):
                other[i] = "changed"
            texts.append(" ".join(other))
    return texts


def _plain(texts):
    sets = [_grams(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label))


def test_near_copies_go(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert 20 < len(left) < 100 and left == _plain(texts)


def test_empty_null_and_repeated_rows(spark):
    rows = [(1, ""), (2, None), (3, "a b"), (3, "a b"), (4, "A  b"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in neardup.jaccard_dedup(docs).collect()) == [0, 1, 3, 3]
    assert neardup.jaccard_dedup(docs.limit(0)).count() == 0


def test_chains_are_one_group():
    sets = [np.arange(i, i + 50, dtype=np.uint64) for i in (0, 5, 10, 100)]
    assert neardup.linked(sets, 0.8).tolist() == [0, 0, 0, 3]


def test_large_groups_are_dealt_to_many_tasks(spark):
    """Groups of more than two classes go by stars, tiles and chunks, and lose no link; the columns keep their names."""
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "en", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, `a.b` double")
    out = neardup.jaccard_dedup(docs, group=2, tile=2)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == _plain(texts)


def test_chains_in_large_groups(spark):
    """Each text is near to the next one only: the group's least class is far from most, and all are one group."""
    rnd = random.Random(5)
    words = [f"{rnd.choice('abcdefgh')}{i}" for i in range(400)]
    texts = [" ".join(words[i * 8 : i * 8 + 200]) for i in range(20)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    for group in (1024, 3):
        assert sorted(r["doc_id"] for r in neardup.jaccard_dedup(docs, group=group, tile=3).collect()) == _plain(texts) == [0]
