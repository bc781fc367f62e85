"""The operators as queries over the given tables: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlore.llm import divergence, exact, negatives
from faultlore.llm.common import documents
from faultlore.llm.divergence import source_divergence
from faultlore.llm.exact import exact_duplicates
from faultlore.llm.jaccard import jaccard_join
from faultlore.llm.languages import languages
from faultlore.llm.mixing import mixture_sizes
from faultlore.llm.near import near_duplicates
from faultlore.llm.negatives import hard_negatives
from faultlore.llm.packing import packed_documents
from faultlore.llm.pii import personal_data
from faultlore.llm.quality import quality
from faultlore.llm.secrets import secrets
from faultlore.llm.substrings import repeated_windows_removed
from faultlore.llm.toxicity import toxicity


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_sizes(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows_removed(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wrong = F.col("vec_id") % 7 == 0  # some labels are moved on, so that close rows differ in label
    return hard_negatives(vectors.withColumn("label", F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_toxicity": op2_toxicity,
    "op3_language_mixture": op3_language_mixture,
    "op4_secret_scan": op4_secret_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLES = {"op6_exact_dedup": exact.SQL, "op11_hard_negatives": negatives.SQL, "op12_source_divergence": divergence.SQL}
