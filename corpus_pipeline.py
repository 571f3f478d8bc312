"""From raw documents to packed training sequences: a pipeline of five of the operators.

Each stage takes what its predecessor kept, written as Parquet and read again, and works on all of it. Every stage but the
last returns the columns of documents, extra ones among them; null ids and repeated rows pass unless a stage says
otherwise; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dekadal.llm._text import saved, table, tuned
from dekadal.llm.decontamination import decontaminate
from dekadal.llm.jaccard_join import one_of_each
from dekadal.llm.packing import pack
from dekadal.llm.pii import mask_pii
from dekadal.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees do not reject. Null and empty texts are scored like others; a very long text is scored
    whole."""
    tuned(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of linked sets of five-word shingles, from a similarity of
    0.8 on; of rows that repeat an id, one. Null and empty texts link with nothing and stay."""
    tuned(spark)
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: less than four fifths of the five-word shingles of each."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; null texts stay null."""
    tuned(spark)
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty text is an end id."""
    tuned(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Boosted trees, a random field and a vocabulary are beyond SQL; the tests hold the stages against plain versions and,
#: for toxicity, against the labels of held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
