"""The pipeline's stages on a small table, each against a plain version."""

import hashlib

import pytest

import corpus_pipeline
from quarry.llm import bpe

ENGLISH = "the meeting was held in the town hall and the people of the village came to hear what had been decided about the road"


@pytest.fixture
def folder(spark, tmp_path):
    leak = "which of these rivers flows through the largest number of countries on the continent of europe today"
    texts = [ENGLISH, ENGLISH, ENGLISH.upper(), "12 34 !!", None, f"before it {leak} and after it", "a note: token = 0123456789abcdef0123456789abcdef in the text of this note", "a quite different text about gardens and the rain that fell on them"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder):
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left.append(sorted(r["doc_id"] for r in docs.collect()))
    assert left == [[0, 1, 2, 5, 6, 7], [0, 5, 6, 7], [0, 6, 7], [0, 6, 7]]
    clean = {r["doc_id"]: r for r in docs.collect()}
    assert clean[6]["text"] == "a note: [SECRET] in the text of this note" and clean[6]["n_chars"] == len(clean[6]["text"])
    encoder = bpe.Encoder(bpe.read_ranks(bpe.public_ranks()[0]), bpe.public_ranks()[1])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(out) == [0, 6, 7]
    for i, r in out.items():
        assert r["token_ids"] == encoder.encode(clean[i]["text"])
        assert r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest()
