"""Clause requests as rows.

The reference answers one HTTP request at a time; here a request table (or
stream) is validated, split into valid rows and a quarantine, routed, and
each phase runs only on the rows that need it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DYNAMIC_FIELDS = ["text", "title", "domain", "type", "anomalous"]
FULL_FIELDS = ["text", "title", "domain"]
# What counts as "anomalous" in a request (string, number or
# boolean true as they arrive in JSON).
TRUTHY = ["True", "1", "true"]


def missing_fields(fields: list[str]) -> Column:
    """Names of mandatory fields that are null."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def validate(requests: DataFrame, fields: list[str] = DYNAMIC_FIELDS) -> tuple[DataFrame, DataFrame]:
    """P10: ``(valid, quarantine)``; quarantine rows carry ``missing``."""
    ok = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    valid = requests.where(ok)
    bad = requests.where(~ok).withColumn("missing", missing_fields(fields))
    return valid, bad


def route(type_col: str = "type", anomalous_col: str = "anomalous") -> Column:
    """``full`` (no type: alpha+beta+gamma), ``beta_gamma`` (type only),
    ``gamma`` (type and a truthy anomalous), ``none`` (type and another
    anomalous value: not anomalous, no policies)."""
    t, a = F.col(type_col), F.col(anomalous_col)
    return (F.when(t == "", "full")
            .when(a == "", "beta_gamma")
            .when(a.isin(TRUTHY), "gamma")
            .otherwise("none"))


def routed(requests: DataFrame) -> DataFrame:
    valid, _ = validate(requests)
    return valid.withColumn("route", route())


def reasoning_answers(requests: DataFrame, id_col: str = "request_id") -> DataFrame:
    """C18 reasoning endpoint: C13 on every valid request ->
    ``(id, title, type, anomalous, anomaly, sentence)``."""
    from clausefold.operators.rules import analyze_clauses
    valid, _ = validate(requests, FULL_FIELDS)
    a = analyze_clauses(valid.withColumn("__title", F.col("title")), id_col, "__title", "text", keep_cols=["title"])
    return a.select(
        id_col, "title", F.col("type"), F.when(F.col("valid"), "False").otherwise("True").alias("anomalous"),
        F.col("policies").alias("anomaly"), F.col("notable").alias("sentence"))
