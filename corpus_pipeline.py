"""From raw documents to a tokenised training mix, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and
returns a DataFrame; ``run`` writes each as Parquet in the shared folder and reads it
back for the next, so a lost executor never reaches back further than one stage. All
but the last return the columns of ``docs``.

1. quality: the classifier learns from ``labels`` and rejects documents it scores under 0.7.
2. exact: of equal texts the longest, then the smallest id stays.
3. near: one document of each class of near duplicates stays.
4. mix: sources come to their target weights; a row for each time a document is taken.
5. tokens: byte-level BPE; ids, their number, and digests of ids and of the decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from massq.llm import bpe, exact, mixing, near, quality
from massq.llm.common import scratch_path, small_row_groups


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_row_groups(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = bpe.digests(bpe.encoded(docs.select("doc_id", "source", "text"), bpe.tokenizer(spark)))
    return rows.select("doc_id", "source", "n_tokens", "_ids", "ids_sha256", "decoded_sha256").withColumnRenamed("_ids", "ids")


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: Neither the classifier's scores nor byte pair encoding can be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
