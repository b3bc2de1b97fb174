"""From raw documents to a tokenised training mix, in five stages of the llm operators.

Each stage gets the rows that its predecessor kept, with the columns of ``documents``, and drops,
repeats or (the last) encodes them. ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and reads it again, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from kinweave.operators.graph import shared_folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labelled training rows, calls toxic."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal but for white space."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by Jaccard >= 0.9 on word 3-grams."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts or repeats each source to its target; a document taken in k epochs stands k times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, packed ids and number of tokens of every row."""
    return pieces.encode(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("n-gram jaccard join", near), ("mixing", mix), ("sentencepiece", encode)]

#: The toxicity classifier is trained, which SQL can't express; the tests run the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's folder goes once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
    return docs
