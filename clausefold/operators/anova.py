"""M3: feature selection by the ANOVA F value, on the long feature table.

A feature's statistics are sums by class over the rows that hold it; the rows
that don't hold it are zeros, which only the classes' sizes have to tell.  So a
vocabulary of any size costs one partial aggregation of the feature table.

The cut keeps exactly the top fraction without a global sort: buckets of F
values find the value at the cut, and only among the features that tie there
is a hash decided by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.operators.features import hash32

#: Places that F values are compared at, so that float noise makes no order.
PLACES = 9
#: Buckets per doubling of F; bits of a tie's hash that make a bucket.
PER_OCTAVE, TIE_BITS = 64, 16
#: Stands for an infinite F value, and for one that is not defined.
INFINITE, UNDEFINED = 1e300, -1.0


def anova_f(features: DataFrame, labels: DataFrame, id_col: str = "id", term_col: str = "term", value_col: str = "value", label_col: str = "label") -> DataFrame:
    """``(term, f)`` of every term of ``features`` (id, term, value) among the
    labelled rows ``labels`` (id, label).

    F is the variance between classes over that within: infinite if no class
    varies, null if nothing varies at all (or there are fewer than two classes,
    or no more rows than classes).  Rows without a label take no part; a row
    holds a term once.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    # one row per class
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    total = sizes.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    rows = features.select(F.col(id_col).alias("id"), F.col(term_col).alias("term"), F.col(value_col).cast("double").alias("x")).join(known, "id")
    by_class = rows.groupBy("term", "label").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    met = by_class.join(sizes, "label").groupBy("term").agg(F.sum(F.col("s") * F.col("s") / F.col("n_class")).alias("means"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    met = met.crossJoin(F.broadcast(total))
    between = F.greatest(F.lit(0.0), F.col("means") - F.col("s") * F.col("s") / F.col("n"))
    # what is left by rounding alone is nothing
    within = F.when(F.col("q") - F.col("means") > F.lit(1e-12) * F.col("q"), F.col("q") - F.col("means")).otherwise(F.lit(0.0))
    varies = between > F.lit(1e-12) * F.col("q")
    free, groups = F.col("n") - F.col("k"), F.col("k") - 1
    f = F.when((groups < 1) | (free < 1), F.lit(None)).when(within > 0, (between / groups) / (within / free)).when(varies, F.lit(float("inf")))
    return met.select("term", f.alias("f"))


def _rank_key(f: Column) -> Column:
    finite = F.when(f == F.lit(float("inf")), F.lit(INFINITE)).otherwise(f)
    return F.round(F.coalesce(finite, F.lit(UNDEFINED)), PLACES)


def select_top(scores: DataFrame, fraction: float, term_col: str = "term", score_col: str = "f", seed: int = 1) -> DataFrame:
    """``scores`` with ``selected``: the ``floor(fraction * n)`` rows of the
    highest score.  Equal scores (to nine places) are taken in the order of a
    hash of the term, then of the term; null scores come last, infinite first.
    Terms are distinct.
    """
    key = F.col("__f")
    rows = scores.withColumn("__f", _rank_key(F.col(score_col)))
    octave = F.when(key <= 0, F.lit(-(1 << 20))).otherwise(F.floor(F.log2(key) * PER_OCTAVE)).cast("long")

    def cut(counts: DataFrame, order: Column, need: Column) -> DataFrame:
        """The one row of ``counts`` (value, n) in which the count of the rows
        in ``order`` reaches ``need``, with the rows ``before`` it."""
        so_far = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = counts.withColumn("before", so_far - F.col("n"))
        return placed.where((F.col("before") < need) & (need <= F.col("before") + F.col("n")))

    # at most a few thousand octave buckets, whatever the scores
    by_octave = rows.groupBy(octave.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    all_rows = Window.partitionBy()
    first = cut(by_octave.withColumn("need", F.floor(F.sum("n").over(all_rows) * F.lit(fraction))), F.col("value").desc(), F.col("need")).select(
        F.col("value").alias("octave"), (F.col("need") - F.col("before")).alias("left"))
    # the distinct values of the one bucket that holds the cut
    inside = rows.crossJoin(F.broadcast(first)).where(octave == F.col("octave"))
    second = cut(inside.groupBy("__f", "left").agg(F.count(F.lit(1)).alias("n")), F.col("__f").desc(), F.col("left")).select(
        F.col("__f").alias("at"), (F.col("left") - F.col("before")).alias("left"))
    # the ties of the one value at the cut, by buckets of their hash
    h = hash32(F.lit(seed), F.col(term_col))
    ties = rows.crossJoin(F.broadcast(second)).where(key == F.col("at")).select(F.col(term_col).alias("t"), h.alias("h"), "left")
    ties = ties.withColumn("b", F.shiftright("h", 32 - TIE_BITS))
    third = cut(ties.groupBy("b", "left").agg(F.count(F.lit(1)).alias("n")), F.col("b").asc(), F.col("left")).select("b", "before")
    rank = F.row_number().over(Window.partitionBy("b").orderBy("h", "t")) + F.col("before")
    last = ties.join(F.broadcast(third), "b").withColumn("r", rank).where(F.col("r") == F.col("left")).select(F.struct("h", "t").alias("last"))
    # one row in all: the value at the cut and the last tie that is taken
    end = second.crossJoin(last).agg(F.max("at").alias("__at"), F.max("last").alias("__last"))
    kept = (key > F.col("__at")) | ((key == F.col("__at")) & (F.struct(h.alias("h"), F.col(term_col).alias("t")) <= F.col("__last")))
    return rows.crossJoin(F.broadcast(end)).withColumn("selected", F.coalesce(kept, F.lit(False))).drop("__f", "__at", "__last")
