import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clausefold.operators import stacking as ST


def rows_of(spark, seed, n=160, d=12):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d))
    y = (x[:, 3] + x[:, 7] > 1).astype(float)
    return spark.createDataFrame([(i, Vectors.dense(x[i]), float(y[i])) for i in range(n)], ["id", "features", "y"])


class Recorder:
    """A learner that says 1 for the ids it was fitted on."""

    seen: list = []

    def fit(self, df):
        own = {r.id for r in df.select("id").collect()}
        Recorder.seen.append(own)
        return Said(own)


class Said:
    def __init__(self, own):
        self.own = own

    def getProbabilityCol(self):
        return "p"

    def transform(self, df):
        return df.withColumn("p", F.col("id").isin(*self.own).cast("double"))


def test_no_row_is_judged_by_a_model_that_knew_it(spark):
    data = rows_of(spark, 1).unionByName(rows_of(spark, 1).where("id < 20"))
    Recorder.seen = []
    out = ST.out_of_fold(data, Recorder, folds=4).collect()
    assert len(out) == 180 and all(r.said == 0.0 for r in out)
    assert len(Recorder.seen) == 4 and all(sum(i in s for s in Recorder.seen) == 3 for i in range(160))


def test_stacked_forest_predicts(spark):
    train, test = rows_of(spark, 2), rows_of(spark, 3)
    model = ST.fit_stacked(train, 2, folds=3, trees=10)
    out = model.transform(test)
    assert set(test.columns) <= set(out.columns)
    right = out.where("prediction = y").count() / test.count()
    assert right > 0.8


def test_elimination_keeps_what_tells(spark):
    kept = ST.eliminate(rows_of(spark, 4), 3, trees=10)
    assert len(kept) == 3 and {3, 7} <= set(kept) and kept == sorted(kept)
