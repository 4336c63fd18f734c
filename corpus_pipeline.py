"""A corpus pipeline of operators, each stage written as Parquet and read again by the next.

``documents`` needs doc_id, text, lang and source; further columns go along with their rows up to the last stage.

Defined results: null and empty texts have no words, so the quality rules reject them; null doc_id stays null and
is the last choice of a group of near duplicates; null lang is a stratum and null source a source of its own;
repeated rows are near duplicates of each other and one stays; the mix may then take a document twice, so an id
may come twice in the result; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, mixing, neardup, pii, quality
from corpusloom.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL cannot express the model stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written below the checkpoint folder and read again."""
    root = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    run_id = uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/pipeline-{run_id}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
