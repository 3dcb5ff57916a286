"""The corpus pipeline: five stages, each written as Parquet and reread by the next.

Language identification drops what it rejects, exact dedup keeps the last of equal texts,
SimHash keeps the first of each near-duplicate component, decontamination drops documents
that hold a benchmark window, packing lays the rest into sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, exact_dedup, language_id, packing, simhash
from ridgeline.llm.common import documents, held_out, shared_dir
from ridgeline.llm.entries import BYTE_TOKENS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    return language_id.keep_identified(docs, model)


def dedup_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def dedup_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(BYTE_TOKENS))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", dedup_exactly),
    ("simhash_dedup", dedup_nearly),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Fingerprints, embeddings and the packing of token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/ridgeline/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
