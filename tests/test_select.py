import pytest
from pyspark.sql import functions as F

from clausefold.operators import select as S


def levels(spark):
    clauses = spark.createDataFrame([("0001", "a", "x"), ("0002", "b", "x"), ("0003", "a", "y")],
                                    "id string, c1 string, c2 string")
    sents = spark.createDataFrame([("0001_001", "p", "t1"), ("0001_002", "q", "t2"), ("0002_001", "p", "t3"),
                                   ("0003_001", "p", "t4"), ("0003_002", "p", "t5")],
                                  "id string, s1 string, text string")
    return clauses, sents


def test_filter_levels_semijoin(spark):
    c, s = levels(spark)
    lv = S.filter_levels([c, s], [["c1", "c2"], ["s1"]], [[["a"], []], [["p"]]])
    assert sorted(r.id for r in lv[0].collect()) == ["0001", "0003"]
    assert sorted(r.id for r in lv[1].collect()) == ["0001_001", "0003_001", "0003_002"]


def test_filter_levels_checks_arity(spark):
    c, s = levels(spark)
    with pytest.raises(ValueError):
        S.filter_levels([c, s], [["c1", "c2"], ["s1"]], [[["a"], []]])
    with pytest.raises(ValueError):
        S.select_labels(c, ["c1", "c2"], [["a"]])


def test_merge_then_split_is_lossless(spark):
    _, s = levels(spark)
    m = S.merge_granules(s.select("id", "text"), level=0)
    got = {r.id: r.text for r in m.collect()}
    assert got["0001"] == "t1 t2 "
    assert got["0003"] == "t4 t5 "
    back = sorted(w for t in got.values() for w in t.split(" ") if w)
    assert back == sorted(r.text for r in s.collect())


def test_propagation_and_unmatched(spark):
    c, s = levels(spark)
    lab = c.where("id <> '0002'")
    m, u = S.propagate_labels(s.select("id", "text"), lab, "c1", 1, 0)
    assert m.count() == 4 and [r.id for r in u.collect()] == ["0002_001"]
    with pytest.raises(ValueError):
        S.propagate_labels(c.withColumn("text", F.lit("")), s, "s1", 0, 1)


def test_keyword_subset(spark):
    df = spark.createDataFrame([(1, "Hello World\nx"), (2, "x\nworld"), (3, "none")], "id int, t string")
    assert sorted(r.id for r in S.keyword_subset(df, "t", ["WORLD"]).collect()) == [1, 2]
    assert [r.id for r in S.keyword_subset(df, "t", ["world"], first_line_only=True).collect()] == [1]
