"""The corpus pipeline: language, copies, near copies, leaks, mix.

Each stage gets the documents that its predecessor kept and returns those that stay, all columns of
`documents`; the last adds each document's tokens and weight. `run` applies the stages to `documents`.

Defined cases. A null or empty text, or one without letters, is rejected by the language stage. Stages drop
rows, not ids: a clean row stays beside a bad one with its doc_id, and a null doc_id is an id like any other,
but for copies, where it stays only if all rows of its text have none. Repeated rows are copies. Null
languages and sources count as undeclared and as one host. An empty table gives an empty one. Extra columns,
whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, exact_dedup, language_id, mixing, simhash_dedup
from gleanery.llm.common import cut
from gleanery.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_dedup.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target shares of sources, languages and topics."""
    return mixing.mix(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("simhash_dedup", near), ("decontaminate", leaks), ("mixing", mix)]

#: SQL expresses neither the language models nor SimHash, alignment or raking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
