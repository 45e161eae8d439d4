"""A corpus pipeline: documents go through five stages, each a job of its own over a written table.

Every stage but the last returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm import decontamination, jaccard, packing, pii, toxicity
from rowsmith.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labelled ones, holds for toxic go."""
    return toxicity.kept(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity the document with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that hardly hold anything else go."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack(packing.pieces(docs, packing.byte_tokenizer()))


STAGES = [("toxicity", reject_toxic), ("near duplicates", one_of_near_duplicates), ("decontamination", decontaminate), ("personal data", redact), ("packing", pack)]
#: The model of the first stage and the tokenizer of the last are beyond SQL; tests take each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
