"""Corpus cleaning pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents scored toxic go;
2. near duplicates: of each group linked by the n-gram Jaccard join, the
   document with the smallest id stays;
3. benchmark decontamination: documents that leak a benchmark item go;
4. personal data: every span found is replaced by its kind in brackets;
5. byte-level BPE: every text left is encoded, and its ids are decoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from poolshift.llm import bpe, decontam, ngram_join, pii, toxicity
from poolshift.llm.text import table, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in the text."""
    return pii.redact_documents(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic_documents), ("n-gram jaccard join", near_duplicates),
          ("benchmark decontamination", benchmark_decontamination), ("personal data", personal_data),
          ("byte-level bpe", byte_level_bpe)]

#: The trained stages cannot be said in SQL; tests/llm/test_pipeline.py holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
