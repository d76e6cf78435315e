"""A training corpus from raw documents: language ID, exact and near deduplication, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that the next reads back from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenforge.llm import exact_dedup, langid, mixing, ngram_join, packing
from lumenforge.plans.lineage import materialize
from lumenforge.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models accept. Null texts, texts without a letter and texts that no learned
    language explains (see ``langid.calibrate``) go; repeated rows are judged alike. An empty or
    unlabelled table keeps nothing."""
    return langid.accepted_documents(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the smallest id.

    Null equals empty; null ids lose to others; of rows that repeat an id and text one stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id; see ``ngram_join.one_of_each``.

    Texts without words, null ones among them, are no copies of anything and all stay."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per epoch: sources share all words by weights 5, 2, 1.

    A null source is a source like others; texts without words come once per whole epoch."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece with its place in a training sequence of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packed", packed),
]

#: Language models, similarity classes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
