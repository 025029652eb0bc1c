"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plotcheck.llm import mixing, packing, quality, similar, suffix_dedup
from plotcheck.llm.common import lean_workers, table
from plotcheck.storage import shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go."""
    lean_workers(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more, the document with the smallest id stays."""
    lean_workers(spark)
    return similar.keep_one_per_group(docs, least=0.8, shingle=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere too are cut out of every text."""
    lean_workers(spark)
    return suffix_dedup.remove_repeats(docs, length=200)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix of sources takes it."""
    lean_workers(spark)
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 ids."""
    lean_workers(spark)
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "space", 1024, 2, cached=60_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages. Tests hold each operator, and the near-duplicate stage, against brute force, and the
#: stages together by their counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
