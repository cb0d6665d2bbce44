"""Readers for the parquet tables the jobs run on.

Reads are lazy; pass ``cols`` so the scan's ReadSchema only holds what the
query needs (Catalyst prunes anyway, this keeps plans readable).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Off by default.  A user who knows that the tables are stored as a few large
#: row groups, which only as many tasks can read, sets it to the number of
#: partitions that scans are dealt out to.
READ_PARTITIONS = "spark.clausefold.readPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    df = df.select(*cols) if cols else df
    partitions = int(spark.conf.get(READ_PARTITIONS, "0"))
    return df.repartition(partitions) if partitions else df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temp view (for ``spark.sql``)."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
