"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns documents; the last returns where each document goes.  Stages are
written as Parquet in the shared folder and read again, so a lost executor
costs no more than its stage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from clausefold.llm import decontam, langid, mixing, sharding, simhash
from clausefold.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter have no language and go; all
    others stay, also if no language can be learned.  A null ``lang`` becomes
    the trained network's answer.  Repeated rows are judged one by one, an
    empty table stays empty, and all columns stay, whatever their names."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays: three-word
    shingles, at most three differing bits.  Null and empty texts are one
    component; of a component the smallest doc_id stays (a null comes last),
    of repeated rows one.  Empty tables and other columns as before."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; no row goes.  Null
    texts stay null, repeated rows are cut alike, without a benchmark nothing
    is cut; empty tables and other columns as before."""
    return decontam.remove_contamination(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix that takes words of a document, in files
    that follow the splitting tree's shards; doc_id repeats over passes.  Null
    texts and texts without words are not taken, null sources are one source,
    repeated rows are documents like any other; empty tables and other columns
    as before."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, size, checksum, shard and slot.  A null
    text has no bytes, rows without doc_id share a shard, equal rows get slots
    of their own; an empty table gives no rows."""
    return sharding.shard_documents(docs)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: A trained network, and draws by XXH64, are beyond DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
