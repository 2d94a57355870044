"""The corpus pipeline: five stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns rows with the columns
of documents; the last returns each row's place in the shards. Empty tables pass through all stages, and columns more,
whatever their names, pass through all but the last. The first three take rows out by doc_id: rows that share an id, null
being one, stay or go together, and an id goes if any of its rows is to go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dyadflow.llm.decontaminate import clean_documents
from dyadflow.llm.mixing import mixed_documents
from dyadflow.llm.near import distinct_documents
from dyadflow.llm.quality import good_documents
from dyadflow.llm.shards import shard_bytes
from dyadflow.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like others; a score of a half stays."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id (null the largest). Texts without words,
    null ones too, are in no group and stay."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; null and empty texts hold none, and a null item has none."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics weigh as raked. Null sources and languages are values; texts
    without words stay; repeated ids share their fate."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot; null ids come first, and equal ids follow by checksum."""
    return shard_bytes(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The quality classifier has no SQL form; tests/llm/test_pipeline.py holds the stages after it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what goes between two stages lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{top}/{k}-{name}")
    return docs
