import math
import re

from clausefold.operators import features as FE
from clausefold.operators import learn as L

TEXTS = [(1, "le chat dort le chat"), (2, "le chien dort"), (3, "un oiseau chante ici"), (4, "le chat chante")]


def test_stage_weights_equal_the_relational_form(spark):
    """The fitted stages give each document the weights of ``tfidf``, in the
    hashed space."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF

    df = spark.createDataFrame(TEXTS, "id long, text string")
    model = Pipeline(stages=FE.tfidf_stages("text")).fit(df)
    got = {r.id: r.features for r in model.transform(df).collect()}
    place = HashingTF(numFeatures=model.stages[1].getNumFeatures())
    for r in FE.tfidf(df, "id", "text").collect():
        assert abs(got[r.id][place.indexOf(r.term)] - r.weight) < 1e-9
    assert all(abs(math.sqrt(sum(x * x for x in v.values)) - 1) < 1e-9 for v in got.values())


def test_gram_counts(spark):
    df = spark.createDataFrame([("abab abab",), ("abab x",), ("",)], "text string")
    got = {r.gram: (r.cnt, r.df) for r in FE.gram_counts(df, "text").collect()}
    assert got["abab"] == (3, 2) and got[" x "] == (1, 1) and got[" abab"] == (3, 2)


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    one = FE.hash_split(df, "k", 0.25)
    assert one.where("is_test").count() == math.ceil(1003 * 0.25) and one.count() == 1003
    assert one.exceptAll(FE.hash_split(df.repartition(7), "k", 0.25)).count() == 0
    assert FE.hash_split(df.limit(0), "k").count() == 0


def test_sentence_model_with_oversampling(spark):
    rows = [(i, "Le client paie vite. Le prix est bas." if i % 4 else "Fin du contrat. Il part.", "p" if i % 4 else "r") for i in range(24)]
    clauses = spark.createDataFrame(rows, "id long, text string, label string")
    cfg = L.SubModel(1, ["p", "r"], granularity=1, oversample=True, classifier="nb")
    train = L.training_rows(clauses, cfg)
    assert {r.y: r["count"] for r in train.groupBy("y").count().collect()} == {0.0: 36, 1.0: 36}
    pred = {r.id: r.y for r in L.predict_ballots(L.fit(train, cfg), clauses, cfg).collect()}
    assert sum(pred[i] == (0 if i % 4 else 1) for i in range(24)) >= 22


def test_sentence_votes_and_null_ballots(spark):
    class Fixed:
        """Predicts 1 where a sentence says so."""

        def transform(self, df):
            from pyspark.sql import functions as F
            return df.withColumn("prediction", F.when(F.col("text").contains("bad"), 1.0).otherwise(0.0))

    clauses = spark.createDataFrame([(1, "good one. bad two. good three"), (2, "good. fine"), (3, ".")], "id long, text string")
    votes = {}
    for mode in ("std", "ato", "not"):
        cfg = L.SubModel(1, ["0", "1"], granularity=1, vote_mode=mode, vote_default=1 if mode == "ato" else 0)
        votes[mode] = {r.id: r.y for r in L.predict_ballots(Fixed(), clauses, cfg).collect()}
    assert votes == {"std": {1: 0, 2: 0, 3: None}, "ato": {1: 1, 2: None, 3: None}, "not": {1: 1, 2: 0, 3: None}}
    ballots = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, None, 0), (2, None, 1)], "id long, y int, pos int")
    assert {r.id: r.y for r in L.ensemble_vote(ballots).collect()} == {1: 1, 2: -1}
    truth = spark.createDataFrame([(1, 1), (2, 0), (9, 0)], "id long, expected int")
    assert {r.id: r.y for r in L.expected_join(L.ensemble_vote(ballots), truth, default=1).collect()} == {1: 1, 2: -1, 9: 1}


def test_models_come_back_or_fail(spark, tmp_dir):
    import pytest

    clauses = spark.createDataFrame([(i, "aa bb" if i % 2 else "cc dd", "p" if i % 2 else "r") for i in range(12)], "id long, text string, label string")
    cfg = L.SubModel(1, ["p", "r"], classifier="nb")
    fitted = L.fit(L.training_rows(clauses, cfg), cfg)
    L.save_model(fitted, f"{tmp_dir}/m")
    back = L.load_model(spark, f"{tmp_dir}/m")
    assert L.predict_ballots(back, clauses, cfg).exceptAll(L.predict_ballots(fitted, clauses, cfg)).count() == 0
    spark.createDataFrame([(0.0,), (1.0,)], "code double").write.parquet(f"{tmp_dir}/broken/codes")
    with pytest.raises(Exception):
        L.load_model(spark, f"{tmp_dir}/broken")


def test_gram_counts_of_words_at_both_sides(spark):
    """Repeated words, short words, other scripts and letters beyond the basic
    plane; no gram is made by an interpreted lambda."""
    texts = ["a de bon bon  bonjour", "bon\t𝒳𝒴𝒵𝒳𝒴 été été x", "", None]

    def grams(t):
        out = []
        for w in re.findall("[^\t\n\x0b\f\r\x1c-\x1f ]+", (t or "").lower()):
            p = f" {w} "
            out += [p] if len(p) <= 4 else [p[i:i + n] for n in (4, 5) for i in range(len(p) - n + 1)]
        return out

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.gram: (r.cnt, r.df) for r in FE.gram_counts(df, "text").collect()}
    all_grams = [grams(t) for t in texts]
    want = {g: (sum(x.count(g) for x in all_grams), sum(g in x for x in all_grams)) for x in all_grams for g in x}
    assert got == want
    plan = FE.gram_counts(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan
