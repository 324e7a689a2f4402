"""A training corpus from ``documents``, in stages that each work on what the one before kept.

The last stage gives doc_id, n_tokens, digests and token_ids of each document that is left. Null
texts count as clean and are encoded as empty; long texts are used whole; repeated rows are near
duplicates of which one stays; an empty table gives no rows; further columns of documents, whatever their names, come through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import bpe, decontam, omh, pii, toxicity
from lodeframe.llm.common import checkpoint, table
from lodeframe.llm.queries import secret
from lodeframe.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return omh.remove_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.remove_personal_data(docs, secret(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("byte_bpe", encode),
]

#: Models and searches that SQL can't express: the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        # Each stage reads its input more than once, so what came before it is kept, in the shared folder.
        docs = stage(spark, checkpoint(docs) if at else docs, sf_dir)
    return docs
