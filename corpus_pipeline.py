"""Corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage works on all that the one before has kept, whole texts. All but the last return the
columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from insight_spark.llm import decontamination, jaccard, lines, packing, toxicity
from insight_spark.llm.common import prepare, table
from insight_spark.session import stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.without_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more sites go, but from the first document that has them; documents stay."""
    prepare(spark)
    return lines.remove_boilerplate(docs, min_sites=10).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 0.8 similar sets of five-word shingles stays."""
    prepare(spark)
    return jaccard.without_near_copies(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a near copy of a benchmark item go."""
    return decontamination.without_leaks(docs, table(prepare(spark), sf_dir, "benchmark"), percent=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.packed_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained classifier and edit distances are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None
