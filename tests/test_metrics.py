import pytest
from pyspark.sql import functions as F

from clausefold.operators import metrics as M


def test_codes(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "l string")
    r = df.select(M.code_labels("l", ["a", "b"], "binary").alias("b"), M.code_labels("l", ["b", "c"], "ref").alias("r"),
                  M.label_to_val("l", ["c", "a"]).alias("v")).collect()
    assert [(x.b, x.r, x.v) for x in r] == [(-1, -1, 1), (1, 1, -1), (1, 2, 0)]
    with pytest.raises(Exception):
        df.select(M.code_labels("l", ["a", "b"], "index")).collect()


def test_report_against_hand_counts(spark):
    """An invented run of three classes, counted by hand: class 0 has tp 3,
    fp 1, fn 1; class 1 tp 1, fp 2, fn 1; class 2 tp 2, fp 0, fn 1."""
    expected, predicted = [0, 0, 0, 0, 1, 1, 2, 2, 2], [0, 0, 0, 1, 1, 0, 2, 2, 1]
    df = spark.createDataFrame(list(zip(expected, predicted, strict=True)), "e int, p int")
    s = M.macro_scores(M.confusion(df, "e", "p")).first()
    assert abs(s.accuracy - 6 / 9) < 1e-12
    assert abs(s.macro_precision - (3 / 4 + 1 / 3 + 1) / 3) < 1e-12 and abs(s.macro_recall - (3 / 4 + 1 / 2 + 2 / 3) / 3) < 1e-12
    f1 = [6 / 8, 2 / 5, 4 / 5]
    assert abs(s.macro_f1 - sum(f1) / 3) < 1e-12 and abs(s.weighted_f1 - (4 * f1[0] + 2 * f1[1] + 3 * f1[2]) / 9) < 1e-12



def test_class_report_and_pivot(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "e int, p int")
    rep = {r.label: r for r in M.class_report(M.confusion(df, "e", "p")).collect()}
    assert rep["1"].precision == pytest.approx(1 / 3) and rep["1"].recall == 1.0
    assert rep["2"].f1 == 0.0 and rep["accuracy"].f1 == 0.5
    long = M.melt_metric(M.class_report(M.confusion(df, "e", "p")).withColumn("support", F.col("support").cast("double")),
                         ["label"], ["precision", "recall", "f1", "support"])
    assert long.count() == 6 * 4


def test_best_or_first(spark):
    df = spark.createDataFrame([("a", ["b", "a"]), ("a", ["c"]), ("a", [])], "e string, p array<string>")
    assert [r.x for r in df.select(M.best_or_first("e", "p").alias("x")).collect()] == ["a", "c", None]
