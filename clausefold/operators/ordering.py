"""Order-dependent helpers that stay parallel when one group is huge.

A plain ``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of
a group to one task.  ``group_positions`` splits each group into coarse,
order-preserving buckets (for example the hour of a timestamp, or an id
range), numbers rows inside each (group, bucket) and adds the number of rows
of all earlier buckets of that group.  The bucket-count table has one row
per (group, bucket), so its running sum is cheap, and a group holding a third
of all rows is numbered by as many tasks as it has buckets.  Numeric buckets
are summed in two levels (stretches of ``STRETCH`` buckets first), so not even
the bucket counts of one group meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Buckets of a stretch.
STRETCH = 4096
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _first_numbers(counts: DataFrame, group_cols: list[str], b: str, two_levels: bool) -> DataFrame:
    """``__off``: the rows of all earlier buckets of the group."""
    def before(keys: list[str], order: str):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("__n").over(w), F.lit(0))

    if not two_levels:
        return counts.select(*group_cols, b, before(group_cols, b).alias("__off"))
    s = "__stretch"
    counts = counts.withColumn(s, F.floor(F.col(b) / F.lit(STRETCH)))
    sums = counts.groupBy(*group_cols, s).agg(F.sum("__n").alias("__n"))
    start = sums.select(*group_cols, s, before(group_cols, s).alias("__start"))
    inner = counts.select(*group_cols, s, b, before([*group_cols, s], b).alias("__in"))
    return inner.join(start, [*group_cols, s]).select(*group_cols, b, (F.col("__start") + F.col("__in")).alias("__off"))


def group_positions(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column,
                    pos_col: str = "pos", size_col: str | None = None) -> DataFrame:
    """Add 1-based position ``pos_col`` of each row inside its group, ordered
    by ``order_cols`` (which must be consistent with ``bucket``: a row in an
    earlier bucket always sorts before a row in a later one).  Optionally add
    the group size as ``size_col``.
    """
    b = "__bucket"
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _first_numbers(counts, group_cols, b, isinstance(d.schema[b].dataType, NUMERIC))
    if size_col:
        offsets = offsets.join(counts.groupBy(*group_cols).agg(F.sum("__n").alias(size_col)), group_cols)
    inner = Window.partitionBy(*group_cols, b).orderBy(*order_cols)
    ranked = d.withColumn("__rk", F.row_number().over(inner))
    out = ranked.join(offsets, on=[*group_cols, b], how="inner")
    return out.withColumn(pos_col, F.col("__off") + F.col("__rk")).drop(b, "__rk", "__off")


def hour_bucket(ts_col: str) -> Column:
    return F.date_trunc("hour", F.col(ts_col).cast("timestamp"))


def id_bucket(id_col: str | Column, width: int = 4096) -> Column:
    return F.floor((F.col(id_col) if isinstance(id_col, str) else id_col) / F.lit(width))


def order_bucket(df: DataFrame, col: str) -> Column:
    """An order-preserving bucket of a leading order column, by its type."""
    kind = df.schema[col].dataType
    if isinstance(kind, NUMERIC):
        return id_bucket(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return hour_bucket(col)
    if isinstance(kind, T.StringType):
        return F.substring(col, 1, 6)
    raise ValueError(f"no bucket for {col}: pass one")
