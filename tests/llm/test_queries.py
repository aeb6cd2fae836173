"""The registered queries on the smallest tables: those with SQL against it, all for their columns and rows, the digests against plain versions."""

import hashlib
import os
import zlib

import brute
import duckdb
import pytest

from quarry.llm.bpe import public_ranks, read_ranks
from quarry.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("QUARRY_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)


def test_digests_equal_plain_versions(spark, duck):
    import tiktoken

    path, pattern = public_ranks()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op3_bpe"](spark, DATA).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert tuple(r) == (r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]] or ""))
    for name, kinds, by_kind in (("op5_pii", brute.PRIVATE, True), ("op7_secrets", brute.SECRETS, False)):
        got = {r["doc_id"]: r for r in QUERIES[name](spark, DATA).collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            counts, digest, spans = brute.base(t, kinds, by_kind)
            assert [got[i][f"n_{k}"] for k, *_ in kinds] == counts and got[i]["base_sha256"] == digest
            assert {f"{kinds[k][0]}:{a}:{b}" for k, a, b in spans} <= set(got[i]["spans"].split(","))


def test_columns_and_rows(spark, duck):
    docs, pages = (duck.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("documents", "pages"))
    one = QUERIES["op1_simhash"](spark, DATA)
    assert one.columns[:3] == ["doc_id", "fingerprint", "component_id"] and one.count() == docs
    six = QUERIES["op6_urls"](spark, DATA).collect()
    assert len(six) == pages and {r["verdict"] for r in six} <= {"allow", "block"}
    nine = QUERIES["op9_langid"](spark, DATA).collect()
    truth = dict(duck.sql("select doc_id, lang from documents where lang is not null").fetchall())
    held = [r for r in nine if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert len(nine) == docs and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in nine)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_nearest_rows_are_found(spark, duck):
    import numpy as np

    rows = [(i, np.array(v, dtype=float)) for i, v in duck.sql("select vec_id, embedding from embeddings").fetchall() if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in QUERIES["op4_ann"](spark, DATA).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = total = 0
    for i, q in rows:
        if i % 20:
            continue
        score = x @ q
        best = [ids[j] for j in np.lexsort((ids, -score)) if ids[j] != i][:20]
        hits += len(set(best) & got[i].keys())
        total += len(best)
    assert hits >= 0.9 * total
