"""The pipeline as a whole, against its stages taken one by one in plain Python."""

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import bpe, decontam, omh, pii, queries, toxicity

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]


def test_run(spark):
    docs, labels, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    left = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score_documents(docs, labels).filter("toxic").collect()}
    clean = docs.filter(~F.col("doc_id").isin([*toxic, -1]))
    kept = {r.doc_id for r in omh.classes(clean).filter("kept").collect()}
    hit = {r.doc_id for r in decontam.contamination(docs, items).filter("contaminated").collect()}
    ranks = bpe.load_ranks(bpe.public_vocabulary()[0])
    plain = tiktoken.Encoding("own", pat_str=bpe.public_vocabulary()[1], mergeable_ranks=ranks, special_tokens={})
    want = {i: plain.encode_ordinary(pii.replaced(left[i], queries.secret(spark))[0] if left[i] else "") for i in kept - hit}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: list(r.token_ids) for r in rows} == want and len(rows) == len(want) < len(left)


def test_odd_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(1, None, "x"), (2, "", "x"), (None, "text without an id", "x"), (4, "word " * 30_000, "x"), (5, "the same", "x"), (5, "the same", "x"), (6, "5 of $%&", None)]
    spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 4, 5, 6]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
