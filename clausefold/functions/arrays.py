"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column, value: str = "value", pos: str | None = None) -> DataFrame:
    """One row per array element (empty or null arrays give no row), with
    the element position as ``pos`` when asked.

    A plain ``explode`` makes Catalyst infer ``size(arr) > 0`` and push that
    filter below the projection computing ``arr``: a costly array
    expression is then evaluated twice, and one built over several
    projections gets copied, substituted, into filters and join conditions.
    The outer generator followed by an explicit filter on the position
    keeps the array computed once.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keep]
    out = df.select(*cols, F.posexplode_outer(arr).alias("__pos", value)).where(F.col("__pos").isNotNull())
    return out.withColumnRenamed("__pos", pos) if pos else out.drop("__pos")


def filter_computed(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` for a condition on columns computed by a large
    projection (the rule analysis, for instance).  A plain filter is pushed
    below that projection with every column reference replaced by its
    expression, which can multiply the plan; routing the test through a
    generator keeps it where it is."""
    keep = F.when(cond, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return explode_rows(df, df.columns, keep, "__keep").drop("__keep")
