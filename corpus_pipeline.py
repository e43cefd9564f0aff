"""From documents to packed training sequences: the stages, in order, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilspark.llm import language_id, lsm_dedup, mixing, ngram_join, packing
from vigilspark.llm.common import ensure_checkpoint_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsm_dedup.drop_copies(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("exact_dedup", dedupe),
    ("ngram_jaccard_join", join_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Neither the network nor the packing can be said in SQL.
ORACLE_SQL: str | None = None


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` written to the shared folder and read again, so that what comes after never computes them anew."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/stage-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each stored but for the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
