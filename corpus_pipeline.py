"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. Rows without an id or text, repeated rows, empty tables and extra
columns are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertloom.llm.chosen_path import keep_first
from alertloom.llm.decontaminate import keep_clean
from alertloom.llm.divergence import keep
from alertloom.llm.encoder import tokenizer_path
from alertloom.llm.packing import pack
from alertloom.llm.store import saved
from alertloom.llm.surrogates import replace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and resemble their language."""
    return keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near copies, by shingles of five words."""
    return keep_first(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words from the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return replace(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Tokenizers and near duplicates have no counterpart in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
