"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

language     drops the documents whose language can't be told
dedup        keeps one document of each class of near-duplicates
decontaminate  drops the documents that hold a window of ``benchmark``
pii          replaces personal data, and terms that disclose it, by labels
packing      turns all that is left into pieces of sequences of 4096 token ids

The first four return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewise.llm.common import Scratch, table
from casewise.llm.decontaminate import drop_contaminated
from casewise.llm.dedup import keep_one
from casewise.llm.language import keep_identified
from casewise.llm.packing import op7_mixture_packing
from casewise.llm.pii import sanitise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_mixture_packing(spark, sf_dir, docs)


STAGES = [
    ("language", language),
    ("dedup", dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("packing", packing),
]

#: Signatures, trained machines and tokenizers can't be told in SQL; tests run it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that ``documents`` become."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return scratch.save(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
