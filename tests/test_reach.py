"""Walks without a depth: long chains, blocks of edges, hubs."""

import random

import pytest

from quarry.operators import analyses as N
from quarry.operators import graph as G


def nodes(df):
    return sorted(r["node"] for r in df.select("node").collect())


def plain(edges, seeds):
    seen = set(seeds)
    while new := {b for a, b in edges if a in seen} - seen:
        seen |= new
    return sorted(seen)


@pytest.fixture()
def steps(monkeypatch):
    """What was written to the shared folder."""
    names = []
    write = G.settled
    monkeypatch.setattr(G, "settled", lambda df, what="step", **more: names.append(what) or write(df, what, **more))
    return names


def test_tests_are_affected_over_any_number_of_files(spark):
    """Each file depends on the one before it: the last one is 100,050 files away."""
    last = 100_050
    deps = spark.range(1, last + 1).selectExpr("id AS from_file_id", "id - 1 AS to_file_id")
    symbols = spark.createDataFrame([(1, 0, True), (2, last, True), (3, last, False), (4, last + 1, True)], "id long, file_id long, is_test boolean")
    found = N.affected_tests(spark.createDataFrame([(0,)], "file_id long"), deps, symbols)
    assert sorted(r["id"] for r in found.collect()) == [1, 2]


def test_a_long_chain_takes_a_round_a_block(spark, monkeypatch, steps):
    monkeypatch.setattr(G, "LOCAL_EDGES", 1_000)
    deps = spark.range(1, 2_501).selectExpr("id AS from_file_id", "id - 1 AS to_file_id")
    symbols = spark.createDataFrame([(1, 0, True), (2, 2_500, True), (3, 2_501, True)], "id long, file_id long, is_test boolean")
    found = N.affected_tests(spark.createDataFrame([(0,)], "file_id long"), deps, symbols)
    assert sorted(r["id"] for r in found.collect()) == [1, 2]
    assert steps.count("walked") <= 4 and len(steps) <= 12


@pytest.mark.parametrize("limit", [0, 7])
def test_blocks_reach_what_a_plain_walk_reaches(spark, monkeypatch, limit):
    """Scattered ids, cycles, a hub whose edges fill several blocks, seeds without edges, repeated rows and nulls."""
    monkeypatch.setattr(G, "LOCAL_EDGES", limit)
    rnd = random.Random(limit)
    ids = [rnd.randrange(-(2**62), 2**62) for _ in range(45)]
    edges = [(rnd.choice(ids[:30]), rnd.choice(ids)) for _ in range(30)] + [(ids[3], b) for b in ids[:25]] + [(ids[40], ids[41]), (ids[41], ids[40]), (ids[42], ids[42])]
    for seeds in ([ids[3]], [ids[40], ids[42], 5]):
        e = spark.createDataFrame([*edges, *edges[:9], (None, 1), (ids[3], None)], "a long, b long")
        s = spark.createDataFrame([(x,) for x in [*seeds, seeds[0], None]], "node long")
        assert nodes(G.reachable(e, "a", "b", s)) == plain(edges, seeds)


def test_a_hub_has_several_blocks_of_bounded_size(spark):
    edges = spark.range(1_000).selectExpr("if(id < 900, 50, id) AS node", "id AS next")
    bounds = G._bounds(edges, 10)
    first, many = G._homes([49, 50, 51], bounds)
    assert many.tolist()[::2] == [1, 1] and many[1] >= 8
    at = G._at_homes(edges.select("node").toPandas()["node"].to_numpy()[:1], bounds)
    assert at["node"].tolist() == [50] * many[1] and at["block"].tolist() == list(range(first[1], first[1] + many[1]))


def test_many_rounds_and_no_seeds(spark, monkeypatch, steps):
    """A chain that changes its block at each hop: more rounds than are kept apart."""
    monkeypatch.setattr(G, "LOCAL_EDGES", 4)
    monkeypatch.setattr(G, "ROUNDS_APART", 3)
    chain = [0, 50, 1, 51, 2, 52, 3, 53]
    e = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
    assert nodes(G.reachable(e, "a", "b", spark.createDataFrame([(chain[0],)], "node long"))) == sorted(chain)
    assert steps.count("walked") > 6 and steps.count("done") >= 2
    assert nodes(G.reachable(e, "a", "b", spark.createDataFrame([], "node long"))) == []
