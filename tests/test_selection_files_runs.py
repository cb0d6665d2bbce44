import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausefold.operators import anova as AV
from clausefold.sources import filetree as FT
from clausefold.sources import runs as RL


def plain_f(x, y):
    """ANOVA F of one feature, as the textbook has it."""
    groups = [x[y == k] for k in np.unique(y)]
    n, k = len(x), len(groups)
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    return between / (k - 1) / (within / (n - k)) if within > 1e-9 else np.inf if between > 1e-9 else None


def test_f_values(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(0.4, size=(90, 25)).astype(float)
    y = rng.integers(0, 3, size=90)
    x[:, 3], x[:, 4], x[:, 5] = (y == 1), 2.0, (y + 1) * 1.0
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(90) for j in range(25) if x[i, j]] + [(500, "t0", 9.0), (501, "t1", 9.0)]
    labels = [(i, f"c{y[i]}") for i in range(90)] + [(500, None)]
    got = {r.term: r.f for r in AV.anova_f(spark.createDataFrame(rows, "id long, term string, value double"), spark.createDataFrame(labels, "id long, label string")).collect()}
    for j in range(25):
        want = plain_f(x[:, j], y)
        assert got[f"t{j}"] == (None if want is None else pytest.approx(want, rel=1e-9)), j


def test_one_class_has_no_f(spark):
    features = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id long, term string, value double")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "id long, label string")
    assert [r.f for r in AV.anova_f(features, labels).collect()] == [None]


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.45, 0.66, 1.0])
def test_exact_share_is_kept(spark, fraction):
    rng = np.random.default_rng(2)
    values = [*(float(v) for v in rng.exponential(3, size=300)), *[0.25] * 400, *[None] * 50, *[float("inf")] * 30, *[0.0] * 40]
    df = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)], "term string, f double").repartition(6)
    out = AV.select_top(df, fraction).collect()
    assert len(out) == len(values) and sum(r.selected for r in out) == int(fraction * len(values))

    def key(v):
        return -1.0 if v is None else min(v, 1e300)

    kept, gone = [key(r.f) for r in out if r.selected], [key(r.f) for r in out if not r.selected]
    assert not kept or not gone or min(kept) >= max(gone)
    again = {r.term for r in AV.select_top(df.repartition(2), fraction).where("selected").collect()}
    assert again == {r.term for r in out if r.selected}


def test_file_tree_round_trip(spark, tmp_dir):
    rows = [("a/b", "x y", "text é\n"), ("a/b", "é%2F", ""), ("c", "..", "z" * 100_000), ("c", "1", "one")]
    df = spark.createDataFrame(rows, "dataset string, id string, text string")
    FT.write_texts(df, f"{tmp_dir}/t")
    FT.write_texts(df.where("id = '1'").withColumn("text", F.lit("two")), f"{tmp_dir}/t")
    got = {tuple(r) for r in FT.read_texts(spark, f"{tmp_dir}/t").collect()}
    assert got == {*rows[:3], ("c", "1", "two")}
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_dir}/t") for f in fs]
    assert len(files) == 4 and all(f.endswith(".txt") for f in files)
    assert FT.read_texts(spark, f"{tmp_dir}/nothing").count() == 0


def test_deeper_trees(spark, tmp_dir):
    df = spark.createDataFrame([("d", str(i), f"t{i}") for i in range(40)], "dataset string, id string, text string")
    FT.write_texts(df, f"{tmp_dir}/t", depth=2)
    assert {tuple(r) for r in FT.read_texts(spark, f"{tmp_dir}/t").collect()} == {tuple(r) for r in df.collect()}
    assert len(FT.FileTreeReader("x", 2).partitions()) == 256 ** 2
    for d, _, files in os.walk(f"{tmp_dir}/t"):
        assert not files or len(os.path.relpath(d, f"{tmp_dir}/t").split("/")) == 3


def test_null_texts_are_an_error(spark, tmp_dir):
    df = spark.createDataFrame([("a", "1", None)], "dataset string, id string, text string")
    with pytest.raises(Exception, match="must not be null"):
        FT.write_texts(df, f"{tmp_dir}/t")


def test_datasets_as_one(spark, tmp_dir):
    FT.write_texts(spark.createDataFrame([("b", "1", "t1"), ("b", "2", "t2"), ("a", "9", "t9")], "dataset string, id string, text string"), f"{tmp_dir}/t")
    FT.write_labels(spark.createDataFrame([("b", "1", " x"), ("a", "9", None), ("b", "3", "y")], "dataset string, id string, label string"), ["label"], f"{tmp_dir}/l")
    rows, mismatches = FT.read_datasets(spark, f"{tmp_dir}/t", f"{tmp_dir}/l", ["label"])
    assert {tuple(r) for r in rows.collect()} == {("00002_1", "b", "t1", "x"), ("00001_9", "a", "t9", "")}
    assert {tuple(r) for r in mismatches.collect()} == {("b", "2", "text_only"), ("b", "3", "label_only")}


def test_runs_replace_themselves(spark, tmp_dir):
    log = f"{tmp_dir}/runs"
    one = spark.createDataFrame([("svm", 1, 0.5), ("nb", 1, 0.25)], "clf string, seed int, f1 double")
    RL.log_runs(one, ["clf", "seed"], log)
    RL.log_runs(one, ["clf", "seed"], log)
    RL.log_runs(spark.createDataFrame([("svm", 1, 0.75), ("svm", 2, 0.1), (None, 2, 0.2)], "clf string, seed int, f1 double"), ["seed", "clf"], log)
    runs = RL.read_runs(spark, log)
    assert {(r.clf, r.seed, r.f1) for r in runs.collect()} == {("svm", 1, 0.75), ("nb", 1, 0.25), ("svm", 2, 0.1), (None, 2, 0.2)}
    assert runs.select("run").distinct().count() == runs.count() == 4
    long = RL.long_runs(runs, ["clf"], ["f1"]).collect()
    assert {(r.clf, r.metric, r.value) for r in long} == {("svm", "f1", 0.75), ("nb", "f1", 0.25), ("svm", "f1", 0.1), (None, "f1", 0.2)}


def test_report_as_rows(spark):
    report = spark.createDataFrame([("a", 0.5, 1.0, 0.75, 4), ("accuracy", None, None, 0.5, 4)], "label string, precision double, recall double, f1 double, support long")
    rows = {(r.label, r.metric): r.value for r in RL.report_rows(report, F.lit("r1")).collect()}
    assert rows["a", "support"] == 4.0 and rows["accuracy", "f1"] == 0.5 and len(rows) == 8
