"""From raw documents to packed training sequences, one operator a stage.

Every stage reads the table the stage before wrote and writes its own, so a
lost executor costs the tasks it ran and not the stages before.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contactweave.llm import gam, near_dedup, packing, pii, quality_rules
from contactweave.llm.common import documents, labels
from contactweave.plans.storage import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores under its threshold."""
    return gam.keep_good(docs, gam.learn(docs, labels(spark, sf_dir)))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the decision list rejects; it is learned from all labelled documents, good and bad."""
    return quality_rules.keep_good(docs, quality_rules.learn(documents(spark, sf_dir), labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, in the texts."""
    return pii.sanitise(docs, pii.disclosing_terms(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("packing", pack),
]

#: A learned classifier, learned rules, tokenising and packing are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
