"""Configurable votes.

Ballots are rows ``(group..., value, order...)`` with an explicit order
(never input order).  A vote is an aggregation to candidates
``(group, value, cnt, pcount, first_seen)`` followed by a ranking window
over the candidates of a group; the number of candidates per group is the
number of distinct ballot values, so the ranking window stays small even when
a group holds a third of all ballots, and the counting is a partial
(map-side) aggregation.

Ranking (closed form of the reference's insertion sort):
  priority ``last``: pcount desc, cnt desc, first_seen desc
  otherwise:         pcount desc, cnt desc, value = default first, first_seen asc
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.operators.ordering import group_positions, order_bucket

MODES = ("std", "ato", "pnd", "not")
LEVELS = ("min", "ele", "ful")
PRIORITIES = ("first", "last")


def _is_default(value: Column, default) -> Column:
    return value.eqNullSafe(F.lit(default))


def tally(ballots: DataFrame, group_cols: list[str], value_col: str, order_cols: list[str],
          mode: str = "std", default=None, priority: str | None = None,
          weight_col: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Count ballots into candidates ``(group..., value, cnt, pcount, first_seen)``.

    Unknown modes fall back to ``std``.  ``pnd`` uses ``weight_col`` when
    given, else position weights (n..1 with priority ``first``, 1..n
    otherwise); positions are computed with ``group_positions`` split by
    ``bucket`` (an order-preserving coarsening of ``order_cols``).
    """
    mode = mode if mode in MODES else "std"
    v = F.col(value_col).alias("value")
    first = F.min(F.struct(*[F.col(c) for c in order_cols])).alias("first_seen")
    b = ballots.select(*group_cols, v, *order_cols,
                       *([F.col(weight_col).alias("__w")] if weight_col else []))

    if mode == "std":
        return b.groupBy(*group_cols, "value").agg(
            F.count(F.lit(1)).alias("cnt"), F.count(F.lit(1)).cast("double").alias("pcount"), first)
    if mode == "ato":
        return b.where(_is_default(F.col("value"), default)).groupBy(*group_cols, "value").agg(
            F.count(F.lit(1)).alias("cnt"), F.count(F.lit(1)).cast("double").alias("pcount"), first)
    if mode == "pnd":
        if weight_col:
            w = F.col("__w").cast("double")
        else:
            if bucket is None:
                bucket = order_bucket(b, order_cols[0])
            b = group_positions(b, group_cols, order_cols, bucket, pos_col="__pos", size_col="__n")
            w = ((F.col("__n") - F.col("__pos") + 1) if priority == "first" else F.col("__pos")).cast("double")
        return b.groupBy(*group_cols, "value").agg(
            F.count(F.lit(1)).alias("cnt"), F.sum(w).alias("pcount"), first)
    # mode == "not": everything but the default; a group that holds nothing
    # else keeps the default with its count.  One aggregation of the ballots;
    # the window only sees a group's candidates
    cands = b.groupBy(*group_cols, "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.count(F.lit(1)).cast("double").alias("pcount"), first)
    isdef = _is_default(F.col("value"), default)
    others = F.max(~isdef).over(Window.partitionBy(*group_cols))
    return cands.withColumn("__others", others).where(~isdef | ~F.col("__others")).drop("__others")


def rank_candidates(cands: DataFrame, group_cols: list[str], default=None,
                    priority: str | None = None) -> DataFrame:
    """Add ``rank`` (1 = winner) to candidates."""
    if priority == "last":
        order = [F.col("pcount").desc(), F.col("cnt").desc(), F.col("first_seen").desc()]
    else:
        order = [F.col("pcount").desc(), F.col("cnt").desc(),
                 _is_default(F.col("value"), default).desc(), F.col("first_seen").asc()]
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return cands.withColumn("rank", F.row_number().over(w))


def elect(ballots: DataFrame, group_cols: list[str], value_col: str, order_cols: list[str],
          mode: str = "std", default=None, priority: str | None = None, level: str = "min",
          weight_col: str | None = None, bucket: Column | None = None,
          keep_empty: bool = True) -> DataFrame:
    """Run a vote per group.

    level ``min``: one row per group ``(group..., winner)``; groups without
      candidates get a null winner when ``keep_empty``.
    level ``ele``: ``(group..., value, pcount)`` for every candidate with the
      top pcount (count ignored).
    level ``ful``: ``(group..., rank, value, pcount)`` for all candidates.
    Unknown levels fall back to ``min``.
    """
    level = level if level in LEVELS else "min"
    cands = tally(ballots, group_cols, value_col, order_cols, mode, default, priority, weight_col, bucket)
    ranked = rank_candidates(cands, group_cols, default, priority)
    if level == "ful":
        return ranked.select(*group_cols, "rank", "value", "pcount")
    if level == "ele":
        top = F.max("pcount").over(Window.partitionBy(*group_cols))
        return ranked.withColumn("__top", top).where(F.col("pcount") >= F.col("__top")).select(
            *group_cols, "value", "pcount")
    winners = ranked.where(F.col("rank") == 1).select(*group_cols, F.col("value").alias("winner"))
    if not keep_empty:
        return winners
    if mode != "ato":  # only a vote for the default alone leaves groups without a candidate
        return winners
    groups = ballots.select(*group_cols).distinct()
    return groups.join(winners, on=group_cols, how="left")


def vote_arrays(values: Column, default=None, priority: str | None = None) -> Column:
    """In-row ``std`` vote over a small array of ballots (used by streaming
    scoring, where each request carries its own ballots).  Returns the winner
    or null for an empty array."""
    idx = F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    distinct_vals = F.array_distinct(values)
    cands = F.transform(distinct_vals, lambda d: F.struct(
        F.size(F.filter(values, lambda x: x.eqNullSafe(d))).alias("cnt"),
        F.when(d.eqNullSafe(F.lit(default)), 1).otherwise(0).alias("isdef"),
        F.array_min(F.transform(F.filter(idx, lambda s: s["v"].eqNullSafe(d)), lambda s: s["i"])).alias("first"),
        d.alias("v")))
    if priority == "last":
        key = lambda c: F.struct(-c["cnt"], -c["first"])
    else:
        key = lambda c: F.struct(-c["cnt"], -c["isdef"], c["first"])
    ordered = F.array_sort(F.transform(cands, lambda c: F.struct(key(c).alias("k"), c["v"].alias("v"))))
    return F.get(ordered, F.lit(0))["v"]
