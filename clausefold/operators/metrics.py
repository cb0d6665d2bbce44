"""Label coding and classification metrics.

Metrics start with one shuffle to the confusion table
``(group..., expected, predicted, cnt)`` - partial aggregation, so a class
holding a third of the rows costs nothing extra - and everything after it
works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.functions.arrays import explode_rows


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# P7 / P8 / P9
def code_labels(col, classes: list[str], mode: str = "index") -> Column:
    """``binary``: classes[0] -> -1, anything else 1;
    ``ref``: position+1 in ``classes`` else -1;
    ``index``: position in ``classes``, unknown label is an error."""
    c = _c(col)
    arr = F.array(*[F.lit(x) for x in classes])
    pos = F.array_position(arr, c)
    if mode == "binary":
        return F.when(c == F.lit(classes[0]), F.lit(-1)).otherwise(F.lit(1))
    if mode == "ref":
        return F.when(pos > 0, pos.cast("int")).otherwise(F.lit(-1))
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), c.cast("string"))).cast("int"))


def label_to_val(col, classes: list[str]) -> Column:
    """Position in ``classes`` or -1."""
    return (F.array_position(F.array(*[F.lit(x) for x in classes]), _c(col)) - 1).cast("int")


def mapping_table(df: DataFrame, model_col: str, name_col: str) -> DataFrame:
    """Per model, distinct names coded by sorted position
    ``(model_no, entry_no, name, code)``."""
    d = df.select(F.col(model_col).alias("model_no"), F.col(name_col).alias("name")).distinct()
    w = Window.partitionBy("model_no").orderBy("name")
    r = d.withColumn("code", (F.row_number().over(w) - 1).cast("int"))
    return r.withColumn("entry_no", F.col("code"))


def inverse_codes(preds: DataFrame, code_col: str, mappings: DataFrame, id_cols: list[str]) -> DataFrame:
    """Code -> name over several mappings; the last match (highest
    ``(model_no, entry_no)``) wins; -1 or no match -> null."""
    # one row per code first: the predictions themselves are only looked up
    m = mappings.where(F.col("code") != -1).groupBy(F.col("code").alias("__code")).agg(
        F.max_by("name", F.struct("model_no", "entry_no")).alias("name"))
    return preds.join(m, F.col(code_col) == F.col("__code"), "left").select(*id_cols, code_col, "name")


# ---------------------------------------------------------------------------
# A9 class balance
def class_ratio(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, cnt, ratio = max count / count)``."""
    c = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    return c.withColumn("ratio", F.max("cnt").over(Window.partitionBy()) / F.col("cnt"))


# ---------------------------------------------------------------------------
# A10 / A11
def confusion(df: DataFrame, expected: str, predicted: str, group_cols: list[str] | None = None,
              count_col: str | None = None) -> DataFrame:
    """``(group..., expected, predicted, cnt)``; a row counts once, or as often
    as its ``count_col`` says."""
    g = group_cols or []
    return df.groupBy(*g, F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(
        (F.sum(count_col) if count_col else F.count(F.lit(1))).alias("cnt"))


def per_label(conf: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """TP/FP/FN/support per label in expected ∪ predicted (U5) and the
    per-label precision, recall, F1 (0 when undefined)."""
    g = group_cols or []
    hit = F.col("expected").eqNullSafe(F.col("predicted"))
    zero = F.lit(0).cast("long")
    # one pass over the confusion table: every cell credits its expected
    # label (tp or fn) and, when wrong, its predicted label (fp)
    credits = F.array(
        F.struct(F.col("expected").alias("label"), F.when(hit, F.col("cnt")).otherwise(zero).alias("tp"),
                 zero.alias("fp"), F.when(hit, zero).otherwise(F.col("cnt")).alias("fn")),
        F.when(~hit, F.struct(F.col("predicted").alias("label"), zero.alias("tp"), F.col("cnt").alias("fp"),
                              zero.alias("fn"))))
    e = explode_rows(conf, g, credits, "c").where(F.col("c").isNotNull())
    s = e.groupBy(*g, F.col("c.label").alias("label")).agg(
        F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn"))

    def ratio(n, d):
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))

    return s.select(
        *g, "label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def macro_scores(conf: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and weighted F1 per group."""
    g = group_cols or []
    pl = per_label(conf, g)
    return pl.groupBy(*g).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def class_report(conf: DataFrame) -> DataFrame:
    """A10: rows ``(label, precision, recall, f1, support)`` per label plus
    ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    pl = per_label(conf).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1",
                                "support", "tp")
    tot = pl.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"),
                 F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                     F.col("mf").alias("f1"), F.col("n").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                     (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    return pl.drop("tp").unionByName(acc).unionByName(mac).unionByName(wei)


def grouped_report(conf: DataFrame, group_cols: list[str]) -> DataFrame:
    """A10 for several reports at once: per-label rows and an ``accuracy``,
    a ``macro avg`` and a ``weighted avg`` row for each group."""
    pl = per_label(conf, group_cols).select(*group_cols, F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support", "tp")

    def total(c: str) -> Column:
        return F.sum(c)

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    none = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), (F.col("tp") / F.col("n")).alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1")))
    tot = pl.groupBy(*group_cols).agg(
        total("support").alias("n"), total("tp").alias("tp"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        weighted("precision").alias("wp"), weighted("recall").alias("wr"), weighted("f1").alias("wf"))
    sums = tot.select(*group_cols, "n", F.explode(rows).alias("r")).select(*group_cols, "r.label", "r.precision", "r.recall", "r.f1", F.col("n").alias("support"))
    return pl.drop("tp").unionByName(sums)


# ---------------------------------------------------------------------------
# A18 / A19 / A20
def pivot_metric(df: DataFrame, row_col: str, col_col: str, value_col: str, values: list) -> DataFrame:
    """One row per ``row_col``, one column per ``values`` of
    ``col_col`` (listed, so no extra pass to find them)."""
    return df.groupBy(row_col).pivot(col_col, values).agg(F.first(value_col))


def melt_metric(df: DataFrame, id_cols: list[str], metric_cols: list[str],
                var_name: str = "metric", value_name: str = "value") -> DataFrame:
    """Wide metrics to long rows."""
    return df.unpivot(id_cols, metric_cols, var_name, value_name)


def best_or_first(expected, predicted) -> Column:
    """The expected label when the predicted list holds it, else the
    first predicted (null for an empty list)."""
    e, p = _c(expected), _c(predicted)
    return F.when(F.array_contains(p, e), e).otherwise(F.try_element_at(p, F.lit(1)))
