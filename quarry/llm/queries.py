"""The registered queries of the corpus operators: thin callables over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans as S
from quarry.llm.ann import nearest
from quarry.llm.bpe import bpe_digests
from quarry.llm.decontam import find_leaks
from quarry.llm.langid import predict_languages
from quarry.llm.ngram_lm import lm_scores
from quarry.llm.pii import KINDS as PRIVATE
from quarry.llm.pii import base_spans, pii_spans
from quarry.llm.secrets import secret_spans
from quarry.llm.shared import table
from quarry.llm.simhash import simhash_groups
from quarry.llm.urls import RULES, judge_urls, match_rule, parts
from quarry.llm.warc import ORACLE as WARC_ORACLE
from quarry.llm.warc import warc_round_trip


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark, table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op5's fixed patterns alone, which SQL can express."""
    out = base_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[S.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(PRIVATE)])


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7's fixed patterns alone."""
    return secret_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's hosts, paths and rules, without the learned verdicts."""
    host, path = parts(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), RULES)
    return rows.withColumns({"rule": rule, "ruled": verdict})


_LUHN = "list_sum(list_transform(range(length(d)), lambda i: (CAST(substr(d, CAST(length(d) - i AS BIGINT), 1) AS INT) * (1 + i % 2)) - CASE WHEN CAST(substr(d, CAST(length(d) - i AS BIGINT), 1) AS INT) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
PII_ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
       CAST(len(list_filter(regexp_extract_all(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(p, 3) AS INT) <= 255)))) AS BIGINT) AS n_ip,
       CAST(len(list_filter(list_transform(regexp_extract_all(x, '[0-9]([ -]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 16 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
       CAST(len(list_filter(list_transform(regexp_extract_all(x, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
FROM t"""
SECRET_ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(x, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda m: length(m) >= 8)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda m: length(m) >= 16)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda m: length(m) >= 32)) AS BIGINT) AS n_hex
FROM t"""
_FITS = {f"{h}{p}": f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in RULES}
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
URL_ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS[h + q]} THEN '{h + q}'" for h, q, _ in _BY_LENGTH)} END AS rule, CASE {' '.join(f"WHEN {_FITS[h + q]} THEN '{v}'" for h, q, v in _BY_LENGTH)} END AS ruled
FROM p"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_ann": op4_ann,
    "op5_pii": op5_pii,
    "op6_urls": op6_urls,
    "op7_secrets": op7_secrets,
    "op8_decontam": op8_decontam,
    "op9_langid": op9_langid,
    "op10_lm": op10_lm,
    "pii_base": pii_base,
    "secret_base": secret_base,
    "url_rules": url_rules,
}

#: DuckDB SQL, for the queries that SQL can express.
ORACLES: dict[str, str] = {"op2_warc": WARC_ORACLE, "pii_base": PII_ORACLE, "secret_base": SECRET_ORACLE, "url_rules": URL_ORACLE}
