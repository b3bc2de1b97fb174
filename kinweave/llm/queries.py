"""The registered queries of this package: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, line_dedup, lm_mixing, mixing, ngram_join, pieces, pii, sql, substring_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(ann.hundredth()))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens, digests of the ids and of the text that is decoded from them."""
    documents = _read(spark, sf_dir, "documents")
    out = pieces.decode(pieces.encode(documents))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), digest.alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_read(spark, sf_dir, "documents"))
    return out.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).drop("base")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, _read(spark, sf_dir, "labels")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents"))


_ALL = [op1_line_dedup, op2_ann, op3_sentencepiece, op4_exact_dedup, op5_substring_dedup, op6_pii, op7_lm_scoring, op8_toxicity, op9_mixing, op10_ngram_jaccard]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
