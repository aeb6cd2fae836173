"""Signatures spare the search most exact comparisons of words and change nothing that it finds."""

import random
from zlib import crc32

import numpy as np
import pytest

from quarry.llm import decontam


def planted(lengths, n_texts):
    """An index of items over few frequent words, and texts of the same words that hold items whole, cut and with words changed."""
    rng = random.Random(8)
    vocabulary = [f"w{i}".encode() for i in range(400)]
    items = [rng.choices(vocabulary, k=rng.choice(lengths)) for _ in range(60)]
    live = np.array(sorted({crc32(w) % decontam.BUCKETS for item in items for w in item}))
    vectors = np.random.default_rng(3).standard_normal((len(live), 24)).astype(np.float32)
    texts = []
    for _ in range(n_texts):
        text = rng.choices(vocabulary, k=rng.randint(0, 900))
        for item in rng.sample(items, 2):
            kept = [w if rng.random() < 0.85 else rng.choice(vocabulary) for w in item]
            at = rng.randint(0, len(text))
            text[at:at] = kept[: rng.randint(len(kept) * 2 // 3, len(kept))]
        texts.append(b" ".join(text))
    return lambda: decontam.Index(list(range(60)), items, live, vectors, decontam.Rules(cosine=0.3)), [None, b"", *texts]


@pytest.mark.parametrize("lengths", [(5, 8, 11), (15, 40), (150, 300, 900)])
@pytest.mark.parametrize("bits", [64, 1024])
def test_signatures_change_nothing(monkeypatch, lengths, bits):
    monkeypatch.setattr(decontam, "SIGNATURE", bits)
    monkeypatch.setattr(decontam.Index._search, "__defaults__", (256,))  # texts lie across many pieces
    index, texts = planted(lengths, 12)
    got = sorted(index().search(texts, words_at_once=5000))
    monkeypatch.setattr(decontam.Index, "sharing", lambda self, signatures, places, items: np.arange(len(places)))
    assert got == sorted(index().search(texts, words_at_once=5000)) and len(got) > 5


def test_few_windows_are_compared_word_by_word(monkeypatch):
    index, texts = planted((16, 20), 300)
    searched, built = index(), []
    monkeypatch.setattr(decontam, "frozenset", lambda *words: built.append(1) or frozenset(*words), raising=False)
    found = list(searched.search(texts))
    windows = sum(len(decontam.words(t)) for t in texts) // 16 * 2
    assert len(found) > 200 and len(built) < windows / 5
