"""M4 and M5: feature elimination and stacking over tree ensembles.

Stacking: the second model sees, beside the features, what the first says of a
row.  For the rows it learns from, that is said by first models that were
fitted without the row's fold; folds follow from a hash of the id, so equal
ids are never on both sides.

Elimination: a forest is fitted, the least important share of the features is
left out, and the narrower rows are written before the next round reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausefold.operators.features import hash32
from clausefold.session import written_table


def forest(features_col: str = "features", label_col: str = "y", trees: int = 50, seed: int = 1):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, numTrees=trees, seed=seed)


def fold_of(id_col: str, folds: int, seed: int = 1) -> Column:
    """The fold of a row, from 0, by a hash of its id."""
    return (hash32(F.lit("fold"), F.lit(seed), F.col(id_col)) % F.lit(folds)).cast("int")


def out_of_fold(data: DataFrame, learner: Callable[[], object], folds: int = 5, seed: int = 1, id_col: str = "id", out_col: str = "said") -> DataFrame:
    """``data`` with ``out_col``: the class probabilities that a model gives a
    row which was fitted on the other folds.  ``learner`` makes an MLlib
    classifier; labels are 0, 1, ... and the learner must know their number
    from the column's metadata if a fold may lack the last."""
    rows = written_table(data.withColumn("__fold", fold_of(id_col, folds, seed)), "folds")
    parts = []
    for k in range(folds):
        # the metadata with the number of classes is lost in writing
        labelled = _with_classes(rows, data)
        model = learner().fit(labelled.where(F.col("__fold") != k))
        own = model.transform(labelled.where(F.col("__fold") == k))
        parts.append(own.select(*data.columns, F.col(model.getProbabilityCol()).alias(out_col)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _with_classes(rows: DataFrame, source: DataFrame, label_col: str = "y") -> DataFrame:
    meta = source.schema[label_col].metadata
    return rows.withColumn(label_col, F.col(label_col).alias(label_col, metadata=meta)) if meta else rows


def labelled(data: DataFrame, classes: int, label_col: str = "y") -> DataFrame:
    """``data`` whose label column says how many classes there are."""
    meta = {"ml_attr": {"type": "nominal", "vals": [str(k) for k in range(classes)], "name": label_col}}
    return data.withColumn(label_col, F.col(label_col).cast("double").alias(label_col, metadata=meta))


class Stacked:
    """The first model, fitted on all rows, and the second on features and
    what the first says."""

    def __init__(self, first, second, features_col: str) -> None:
        self.first, self.second, self.features_col = first, second, features_col

    def transform(self, df: DataFrame) -> DataFrame:
        said = self.first.transform(df).select(*df.columns, F.col(self.first.getProbabilityCol()).alias("__said"))
        return self.second.transform(_joined(said, self.features_col, "__said")).drop("__said", "__stacked")


def _joined(df: DataFrame, features_col: str, said_col: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=[features_col, said_col], outputCol="__stacked").transform(df)


def fit_stacked(data: DataFrame, classes: int, folds: int = 5, trees: int = 50, id_col: str = "id", features_col: str = "features", label_col: str = "y") -> Stacked:
    """M5 on (id, features, y): a forest stacked on a forest."""
    rows = labelled(data, classes, label_col)
    said = out_of_fold(rows, lambda: forest(features_col, label_col, trees, 1), folds, id_col=id_col, out_col="__said")
    second = forest("__stacked", label_col, trees, 2).fit(_joined(_with_classes(written_table(said, "stacked"), rows, label_col), features_col, "__said"))
    return Stacked(forest(features_col, label_col, trees, 1).fit(rows), second, features_col)


def eliminate(data: DataFrame, n_keep: int, step: float = 0.4, features_col: str = "features", label_col: str = "y", trees: int = 20) -> list[int]:
    """M4: the features that are left when, round by round, the ``step`` share
    of the least important ones goes until ``n_keep`` are left; of equally
    important ones the first goes.  Only the importances, one number a
    feature, come to the driver."""
    from pyspark.ml.feature import VectorSlicer
    kept = list(range(len(data.select(features_col).first()[0])))
    rows = written_table(data.select(features_col, label_col), "elimination")
    while len(kept) > n_keep:
        importance = forest(features_col, label_col, trees).fit(_with_classes(rows, data, label_col)).featureImportances.toArray()
        order = sorted(range(len(kept)), key=lambda i: (importance[i], i))
        drop = min(max(1, int(len(kept) * step)), len(kept) - n_keep)
        stay = sorted(order[drop:])
        kept = [kept[i] for i in stay]
        narrow = VectorSlicer(inputCol=features_col, outputCol="__narrow", indices=stay).transform(rows)
        rows = written_table(narrow.select(F.col("__narrow").alias(features_col), label_col), "elimination")
    return kept
