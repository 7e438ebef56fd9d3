"""The corpus pipeline: five stages, each one operator, each written as Parquet and read again.

quality rules -> near-duplicates (five words, 0.8) -> benchmark decontamination -> mixing -> token files

Defined results: null and empty texts fail the quality rules. A null doc_id is never a near-duplicate, draws
its copies by its text and comes first in the token files. Repeated rows are judged row by row, and rows that
share a doc_id count as one document for grouping. Other columns, whatever their names, go through all stages
but the last. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.common import shared_dir, table, written
from gridlark.llm.decontaminate import decontaminate
from gridlark.llm.mixing import mix
from gridlark.llm.near_dedup import keep_representatives
from gridlark.llm.quality import keep_quality
from gridlark.llm.token_files import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the chain is trained on the labelled documents that came in."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_representatives(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target share asks for, shuffled."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the corpus, and what they hold for each document."""
    import public_tokenizers

    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmark), ("mixing", mixed), ("token_files", tokens)]

#: Line chains, signatures and tokenizers are beyond SQL: tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{k}-{name}", folder)
    return docs
