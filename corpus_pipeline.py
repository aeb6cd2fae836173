"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_encode, public_ranks
from quarry.llm.decontam import decontaminate
from quarry.llm.langid import fold, identify, train
from quarry.llm.neardup import jaccard_dedup
from quarry.llm.secrets import redact_secrets
from quarry.llm.shared import drop_kept, kept, named


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go: those without a letter (null and empty texts too), and those that even the
    best language's trees code in more than 7 bits a byte, such as texts of other scripts. Texts of any length are coded whole,
    repeated rows have one fate, an empty table gives an empty one."""
    trees = train(docs.where(fold("doc_id", 5) != 0))
    return identify(docs, trees, most_bits=7.0, pred="__lang", share="__share").where("__lang != 'und'").select(*named(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like texts (five-word shingles, Jaccard similarity of 0.8 or more) stays: that of the least doc_id."""
    return jaccard_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or reworded, go; null and empty texts hold none, repeated rows have one fate.
    Long texts are searched whole. An empty table gives an empty one, an empty benchmark leaves all."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with each secret in it replaced by a mark; n_chars is that of the new text. Null and empty texts stay as
    they are, repeated rows are treated alike, long texts are scanned whole, an empty table gives an empty one."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*named(*docs.columns))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the digests of the ids and of the decoded text; a null text counts as empty.
    Texts of any length are encoded whole, each row for itself; an empty table gives an empty one."""
    return bpe_encode(docs.select("doc_id", "lang", "source", "text"), *public_ranks())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_tokens),
]

#: Trees, fingerprints, retrieval and merges have no form in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_kept(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
