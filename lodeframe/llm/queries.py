"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import alignment, bpe, decontam, langid, licenses, omh, packing, pii, sharding, spelling, topk, toxicity, urlfilter
from lodeframe.llm.common import table


def secret(spark: SparkSession) -> bytes:
    """The key of surrogates, from the session's ``spark.lodeframe.key``; unset, as in tests, a key that is no secret."""
    return (spark.conf.get("spark.lodeframe.key", None) or "no secret").encode()


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), secret(spark))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_url_filter, op4_byte_bpe, op5_sharding, op6_toxicity, op7_pii_surrogates, op8_order_minhash, op9_decontamination, op10_exact_topk, op11_token_alignment, op12_best_fit_packing, op13_spelling_variants)}

ORACLES = {
    "op1_license_scan": licenses.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
