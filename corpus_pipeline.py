"""A training corpus from documents, in five stages; each works on all rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow import session
from weirflow.llm import bpe, exact, mixing, simhash, toxicity
from weirflow.llm.tables import prepare, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.keep_clean(docs, read(prepare(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints."""
    prepare(spark)
    return simhash.deduplicate(docs, shingle=3, radius=3)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. Every one stays at least once; those of rarer languages come again."""
    return mixing.mix(docs, read(prepare(spark), sf_dir, "labels"), domain="lang")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids: all columns but the text, with n_tokens and ids."""
    prepare(spark)
    return bpe.encoded(docs, digests=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_languages),
    ("bpe", encode),
]

#: Training, components and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(prepare(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        path = session.shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # what a stage has read is not needed once the next table is written
            session.delete_dir(spark, before)
        before = path
    return docs
