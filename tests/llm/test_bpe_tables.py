"""The encoder's tables: bounded in bytes, and right when other entries take over a slot."""

import random
import time
import tracemalloc

import pytest

from quarry.llm import bpe


@pytest.fixture(scope="module")
def public():
    path, pattern = bpe.public_ranks()
    return bpe.read_ranks(path), pattern


def test_a_million_pieces_stay_below_64_mb(public):
    encoder = bpe.Encoder(*public)
    encoder.transducer.encode = lambda data: [len(data), 300, 40_000]
    tracemalloc.start()
    for at in range(0, 1_000_000, 1000):
        pieces = [f" {n * 2654435761 % (1 << 48):012x}" for n in range(at, at + 1000)]
        for _ in range(2):
            assert set(map(encoder._piece, pieces)) == {"13,300,40000"}
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 64e6


def test_entries_that_share_slots_are_told_apart(public, monkeypatch):
    for name, size in (("MEMO_PIECES", 4), ("RARE_SLOTS", 3), ("PAIR_SLOTS", 5)):
        monkeypatch.setattr(bpe, name, size, raising=False)
    ranks, pattern = public
    encoder, rng = bpe.Encoder(ranks, pattern), random.Random(3)
    words = ["".join(rng.choice("etaoinéñß漢字\0") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    for _ in range(400):
        text = " ".join(rng.choices(words, k=20))
        pieces = [piece.encode() for piece in encoder.all(text)]
        assert encoder.encode(text) == [i for p in pieces for i in ([ranks[p]] if p in ranks else bpe.merge_by_rank(ranks, p))]
    assert len(encoder.rare) == 3 and len(encoder.transducer.pairs) == 5


def test_token_ids_of_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(0, None), (1, "a b"), (2, ""), (3, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], len(r["token_ids"])) for r in bpe.bpe_encode(rows, *bpe.public_ranks()).collect()}
    assert got == {0: (0, 0), 1: (2, 2), 2: (0, 0), 3: (1, 1)}


def test_invented_words_cost_less_than_merging_each_twice(public):
    """CPU time of the transducer on words it meets once, against plain merges of the same words; the best of three."""
    ranks, rng = public[0], random.Random(1)
    parts = "ein ach sch erk eit ber lich über be nacht öpf stß ung au er keit ver tz zu ge te ch pf".split()
    words = list({(" " + "".join(rng.choices(parts, k=rng.randint(2, 4)))).encode() for _ in range(20_000)} - ranks.keys())
    shares = []
    for _ in range(3):
        machine = bpe.Transducer(ranks)
        begin = time.process_time()
        got = [machine.encode(w) for w in words]
        middle = time.process_time()
        assert got == [bpe.merge_by_rank(ranks, w) for w in words]
        shares.append((middle - begin) / (time.process_time() - middle))
    assert min(shares) < 1.5


def test_pairs_are_stable_if_plain_merges_leave_them(public):
    ranks, rng = public[0], random.Random(4)
    machine = bpe.Transducer(ranks)
    own = [rank for token, rank in ranks.items() if bpe.merge_by_rank(ranks, token) == [rank]]
    some = rng.sample(own, 300)
    for one, two in [(rng.choice(own), rng.choice(own)) for _ in range(5000)] + [(a, b) for a in some[:70] for b in some[:70]] + [(a, a) for a in some]:
        assert machine._stable(one << 32 | two) == (bpe.merge_by_rank(ranks, machine.tokens[one] + machine.tokens[two]) == [one, two])


def test_long_pieces_whatever_is_given_out_or_dropped_meanwhile(public, monkeypatch):
    ranks, rng = public[0], random.Random(6)
    pieces = [bytes(rng.choices(letters, k=700)) for letters in (b"ab", b"etaoin", bytes(range(256)), "éñß漢字".encode())]
    pieces += [b"a" * 3000, b" " * 3000, b"=-" * 900, b"the" * 500]
    for settle, states in ((1, 60_000), (7, 60_000), (64, 3), (4096, 1)):
        monkeypatch.setattr(bpe, "SETTLE", settle)
        monkeypatch.setattr(bpe, "MAX_STATES", states)
        machine = bpe.Transducer(ranks)
        for piece in pieces:
            assert machine.encode(piece) == bpe.merge_by_rank(ranks, piece) and len(machine.states) <= states
