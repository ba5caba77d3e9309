"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage but the last returns the columns of documents, and the last adds the shard and the slot in it, so that
its output is what a training run reads.  Null and empty texts, repeated rows and null ids are documents like any
other: a null text is not toxic unless the machine's prior says so, links with nothing, has no benchmark passage,
counts as no tokens and is put into a shard.  Columns of any name are carried through; only shard and slot are taken.
An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import decontaminate, jaccard, mixing, sharding, toxicity
from sitelens.llm.common import pinned, shared_folder, table, unpin_since


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("decontamination", benchmark_text),
    ("mixing", mix),
    ("sharding", shards),
]
#: The fitted and iterative stages have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        mark = pinned()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        unpin_since(spark, mark)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
