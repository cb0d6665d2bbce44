"""Model fitting and scoring with MLlib.

Sub-models are MLlib ``PipelineModel``s (vectorizer stages + classifier).
Their predictions become ballots ``(id, model_no, y)`` and every vote after
that is the relational vote of ``operators.vote``.  The driver only loops
over the (few) configurations; all data work is distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausefold.functions import text as X
from clausefold.functions.arrays import explode_rows
from clausefold.operators import features as FE
from clausefold.operators import metrics as M
from clausefold.operators import vote as V


@dataclass
class SubModel:
    """One sub-model configuration."""
    model_no: int
    classes: list[str]                 # label classes, code = position
    granularity: int = 0               # 0 = clause text, 1 = sentences (label propagated)
    transformer: str = "tfidf"         # count | tfidf | hash | doc2vec
    binary: bool = False               # classes[0] -> -1, others 1 (P7 binary)
    ref_classes: list[str] = field(default_factory=list)  # P7 ref mode when given
    oversample: bool = False           # G1 on the training rows
    classifier: str = "svm"            # svm | logreg | nb | rf | mlp | words
    vectorizer_args: dict = field(default_factory=dict)
    vote_mode: str = "std"             # vote of sentence ballots: std | ato | not
    vote_default: int | None = None


def code_column(cfg: SubModel, label_col: str = "label"):
    if cfg.binary:
        return M.code_labels(label_col, cfg.classes, "binary")
    if cfg.ref_classes:
        return M.code_labels(label_col, cfg.ref_classes, "ref")
    return M.label_to_val(label_col, cfg.classes)


def classifier(name: str, features_col: str = "features", label_col: str = "y"):
    """M1 / M2: the default is a linear SVM (C = 25, squared hinge, L2)
    one-vs-rest; others are the exploration zoo."""
    from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier

    from clausefold.operators.svm import squared_hinge_svm
    if name == "logreg":
        return LogisticRegression(featuresCol=features_col, labelCol=label_col, maxIter=50)
    if name == "nb":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import Binarizer
        # Bernoulli NB reads presence/absence: binarise the features first
        return Pipeline(stages=[Binarizer(threshold=0.0, inputCol=features_col, outputCol="__bin"),
                                NaiveBayes(featuresCol="__bin", labelCol=label_col, modelType="bernoulli")])
    if name == "rf":
        return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, numTrees=50, seed=1)
    if name == "mlp":
        raise ValueError("mlp needs layer sizes; use mlp_classifier()")
    return squared_hinge_svm(features_col, label_col)


#: The cleaned text of rows that several models read, which is then not
#: cleaned anew for each.
CLEAN = "__clean"


def cleaned(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``CLEAN``, as it is where they have it."""
    return rows if CLEAN in rows.columns else X.with_clean_full(rows, text_col, CLEAN)


def sentence_rows(clauses: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """X9 + P6 on cleaned text: ``(id, sno, text)`` per non-empty sentence."""
    return explode_rows(cleaned(clauses, text_col), [id_col], X.split_sentences(F.col(CLEAN)), text_col, "sno")


def training_rows(data: DataFrame, cfg: SubModel, id_col: str = "id", text_col: str = "text",
                  label_col: str = "label") -> DataFrame:
    """Cleaned text and coded label ``y`` (double) at the configured
    granularity; sentence rows inherit their clause label (J3)."""
    known = [CLEAN] if CLEAN in data.columns else []
    d = data.select(id_col, text_col, label_col, *known)
    if cfg.granularity >= 1:
        s = sentence_rows(d, id_col, text_col)
        d = s.join(d.select(id_col, label_col), id_col)
        d = d.select(F.concat_ws("_", F.col(id_col).cast("string"), F.col("sno").cast("string")).alias(id_col),
                     text_col, label_col)
    else:
        d = cleaned(d, text_col).select(id_col, F.col(CLEAN).alias(text_col), label_col)
    d = d.withColumn("y", code_column(cfg, label_col).cast("double"))
    if cfg.binary:
        d = d.withColumn("y", F.when(F.col("y") < 0, 0.0).otherwise(1.0))
    else:
        d = d.where(F.col("y") >= 0)
    if cfg.oversample:
        from clausefold.operators.balance import random_oversample
        d = random_oversample(d, "y", id_col)
    return d


@dataclass
class Prepared:
    """Rows to learn from, rows to test on, and the size of each class
    after each step (A17)."""
    train: DataFrame
    test: DataFrame
    report: DataFrame


def prepare(data: DataFrame, cfg: SubModel, generations: int = 0, fraction: float = 0.25, seed: int = 1) -> Prepared:
    """split, then ``generations`` rounds of genetic oversampling (G2) of
    the training texts, then cleaning and coding, and random oversampling (G1)
    if the configuration asks for it; the vectorizer follows in ``fit``.
    ``data`` is (id, text, label) with an integer id; a child's id is its key.
    """
    from clausefold.operators import balance as B

    split = FE.hash_split(data, "id", fraction, seed)
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    grown = train.select(F.col("id").cast("string").alias("id"), "text", "label")
    if generations:
        out = B.genetic_oversample(train, "label", "id", "text", generations, seed, data.sparkSession)
        grown = out.select(B.key_string(F.col("__key")).alias("id"), "text", "label")
    rows = training_rows(grown, cfg)

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("label").agg(F.count(F.lit(1)).alias(name))

    report = sizes(data, "n_rows").join(sizes(train, "n_train"), "label", "left").join(
        sizes(grown, "n_genetic"), "label", "left").join(sizes(rows, "n_prepared"), "label", "left")
    return Prepared(rows, test, report)


def fit(data: DataFrame, cfg: SubModel, text_col: str = "text"):
    """Fit vectorizer + classifier as one ``PipelineModel``; the
    classifier ``words`` is a naive Bayes model of word tables."""
    if cfg.classifier == "words":
        from clausefold.operators import bayes
        return bayes.fit(data, text_col)
    from pyspark.ml import Pipeline

    from clausefold.session import checkpoint_dir
    stages = FE.vectorizer_stages(cfg.transformer, text_col, "features", **cfg.vectorizer_args)
    # the cleaned, coded rows are read by every vectorizer fit and every
    # optimizer pass: write them once to the shared checkpoint folder, which
    # also cuts the lineage (every job of the fit then plans a plain scan)
    # the optimizer waits for its largest task in every pass, so the rows are
    # dealt evenly to all cores
    checkpoint_dir(data.sparkSession)
    data = data.repartition(data.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)
    # classes present in the training rows (a handful of values): one-vs-rest
    # needs labels 0..k-1, so sparse codes are made dense for the fit and
    # mapped back at prediction time; a single class needs no model
    counts = {r["y"]: r["count"] for r in data.groupBy("y").count().collect()}
    codes = sorted(counts)
    if len(codes) <= 1:
        return FittedSubModel(None, codes)
    dense = data.withColumn("y", (F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("y")) - 1).cast("double"))
    model = Pipeline(stages=stages + [classifier(cfg.classifier)]).fit(dense)
    return FittedSubModel(model, codes)


class FittedSubModel:
    """A fitted pipeline and the class codes its dense predictions stand
    for.  ``transform`` adds ``prediction`` in the original codes."""

    def __init__(self, model, codes: list[float]):
        self.model, self.codes = model, codes

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            c = self.codes[0] if self.codes else -1.0
            return df.withColumn("prediction", F.lit(float(c)))
        out = self.model.transform(df)
        back = F.element_at(F.array(*[F.lit(float(c)) for c in self.codes]), F.col("prediction").cast("int") + 1)
        return out.withColumn("prediction", back)

    def save(self, path: str) -> None:
        """The pipeline plus its class codes."""
        spark = SparkSession.getActiveSession()
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/pipeline")
        spark.createDataFrame([(float(c),) for c in self.codes], "code double").write.mode("overwrite").parquet(f"{path}/codes")


def predict_ballots(model, clauses: DataFrame, cfg: SubModel, id_col: str = "id",
                    text_col: str = "text") -> DataFrame:
    """One ballot ``(id, model_no, y)`` per clause.  Sentence models
    predict every sentence and the sentence ballots are voted per clause by
    the model's vote mode, ties to the earlier sentence.  A vote without a
    winner (``ato``, and no sentence has the default) and a clause without
    sentences give a null ballot."""
    if cfg.granularity >= 1:
        s = sentence_rows(clauses, id_col, text_col)
        p = model.transform(s).select(id_col, "sno", F.col("prediction").cast("int").alias("y"))
        v = V.elect(p, [id_col], "y", ["sno"], mode=cfg.vote_mode, default=cfg.vote_default, level="min", keep_empty=False)
        out = clauses.select(id_col).join(v, id_col, "left").select(id_col, F.col("winner").alias("y"))
    else:
        c = cleaned(clauses, text_col).select(id_col, F.col(CLEAN).alias(text_col))
        out = model.transform(c).select(id_col, F.col("prediction").cast("int").alias("y"))
    return out.withColumn("model_no", F.lit(cfg.model_no))


def ensemble_vote(ballots: DataFrame, id_col: str = "id", mode: str = "std", default=None,
                  priority: str | None = "first") -> DataFrame:
    """Vote of all ballots of a clause (``pos`` orders them; a
    keyword ballot at ``pos = 0`` wins ties).  Null ballots don't vote; a
    clause that is left without a winner gets -1."""
    v = V.elect(ballots.where(F.col("y").isNotNull()), [id_col], "y", ["pos"], mode=mode, default=default, priority=priority,
                level="min", keep_empty=False)
    every = ballots.groupBy(id_col).agg(F.lit(1).alias("__one")).drop("__one")
    return every.join(v, id_col, "left").select(id_col, F.coalesce(F.col("winner"), F.lit(-1)).alias("y"))


# The registry of a trained analysis, one row a sub-model
REGISTRY = ("phase string, type string, model_no int, path string, granularity int, vote_mode string, vote_default int, "
            "only_policy string, classes array<string>, sentence_mode string, sentence_default int, types array<string>")


def save_model(model: "FittedSubModel", path: str) -> None:
    """Model artefact (vectorizer + classifier in one pipeline, and the
    class codes)."""
    model.save(path)


def load_model(spark: SparkSession, path: str) -> "FittedSubModel":
    """A word model has its classes, any other its codes; of these a model of
    one class has no pipeline, any other must have one, and a missing one is
    an error."""
    from pyspark.ml import PipelineModel
    from pyspark.sql.utils import AnalysisException

    from clausefold.operators import bayes
    try:
        return bayes.load(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    codes = sorted(r[0] for r in spark.read.parquet(f"{path}/codes").collect())
    return FittedSubModel(PipelineModel.load(f"{path}/pipeline") if len(codes) > 1 else None, codes)


def evaluate(pred: DataFrame, truth: DataFrame, id_col: str = "id") -> DataFrame:
    """Macro scores of predictions against expected codes."""
    return M.macro_scores(M.confusion(expected_join(pred, truth, id_col=id_col), "expected", "y"))


def expected_join(pred: DataFrame, truth: DataFrame, default: int = -1, id_col: str = "id") -> DataFrame:
    """Every expected row with its prediction; a row that none predicts
    gets the default code (-1 when a model is evaluated, 1 in the searches)."""
    p = pred.select(id_col, F.col("y"))
    return truth.join(p, id_col, "left").withColumn("y", F.coalesce("y", F.lit(default)))


# ---------------------------------------------------------------------------
# M2 / M3 / M4 / M5: exploration extras
def mlp_classifier(n_features: int, n_classes: int, hidden: int = 32, features_col: str = "features",
                   label_col: str = "y"):
    """M2: multilayer perceptron (one hidden layer)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    return MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col,
                                          layers=[n_features, hidden, n_classes], maxIter=50, seed=1)


def percentile_selector(percentile: float, features_col: str = "features", out_col: str = "selected",
                        label_col: str = "y"):
    """M3: keep the given fraction of features ranked by the ANOVA F test."""
    from pyspark.ml.feature import UnivariateFeatureSelector
    sel = UnivariateFeatureSelector(featuresCol=features_col, outputCol=out_col, labelCol=label_col,
                                    selectionMode="percentile")
    sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(percentile)
    return sel
