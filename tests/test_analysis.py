import re

import pytest
from pyspark.sql import functions as F

from clausefold.operators import analysis as AN
from clausefold.operators import learn as L

LABELS = "id long, title string, text string, type string, policy string"
TEXTS = {
    ("paiement", "R11"): "Le client paie par cheque au comptoir.", ("paiement", "None"): "Le client regle par virement bancaire.",
    ("paiement", "R12"): "Le reglement vient apres une longue attente.",
    ("resiliation", "R9"): "Le contrat cesse sans avertir.", ("resiliation", "None"): "Le depart suit un preavis convenu.",
    ("resiliation", "R7"): "Le preavis dure une eternite.",
    ("indemnisation", "R13"): "Une indemnite est due en cas de dommage.",
}


def clauses(spark, n, seed):
    rows = []
    for i in range(n):
        (t, p), text = list(TEXTS.items())[(i * 5 + seed) % len(TEXTS)]
        rows.append((seed * 1000 + i, "Article", f"{text} Mot{i % 3}.", t, p))
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def fitted(spark):
    return AN.train_phases(clauses(spark, 56, 1), ["paiement", "resiliation", "indemnisation", "non_concurrence"], classifier="nb")


def test_phases_on_held_out_clauses(spark, fitted):
    test = clauses(spark, 28, 2)
    got = {r.id: r for r in AN.analyze(fitted, test.select("id", "title", "text")).collect()}
    rows = test.collect()
    assert len(got) == len(rows)
    assert sum(got[r.id].type == r.type for r in rows) / len(rows) > 0.8
    assert sum(got[r.id].anomalous == (r.policy != "None") for r in rows) / len(rows) > 0.7
    for r in rows:
        g = got[r.id]
        assert (g.anomaly is None) == (not g.anomalous)
        if g.anomalous and g.type == "indemnisation":
            assert g.anomaly == ["R13"]  # its single policy, without a model
    reports = AN.evaluate_phases(AN.analyze(fitted, test.select("id", "title", "text")), test.select("id", "type", "policy"), fitted.types, ["R7", "R9", "R11", "R12", "R13"])
    accuracy = {r.report: r.f1 for r in reports.where("label = 'accuracy'").collect()}
    assert set(accuracy) == {"type", "validity", "policy_first", "policy_best"} and accuracy["policy_best"] >= accuracy["policy_first"]


def test_unknown_types_use_the_default_ensembles(spark, fitted):
    assert fitted.gamma["indemnisation"].only_policy == "R13" and not fitted.gamma["indemnisation"].models
    assert "non_concurrence" not in fitted.beta  # no training clause
    rows = clauses(spark, 7, 3).withColumn("type", F.lit(None).cast("string"))
    out = AN.phase_beta_gamma(fitted, rows.select("id", "text", "type"))
    assert out.count() == 7 and out.where("anomalous AND anomaly IS NULL").count() == 0


def test_title_keyword_wins_ties(spark, fitted):
    d = spark.createDataFrame([(1, "Indemnisation resiliation", "x y"), (2, "Rien", "x y")], "id long, title string, text string")
    assert [(r.id, r.y, r.pos) for r in AN.title_ballot(d, fitted.types).collect()] == [(1, 1, 0)]


def test_answers_follow_the_routes(spark, fitted):
    t = TEXTS["paiement", "R11"]
    req = spark.createDataFrame([
        (1, "Article", t, "d", "", ""), (2, "Article", t, "d", "paiement", ""), (3, "Article", t, "d", "indemnisation", "True"),
        (4, "Article", t, "d", "paiement", "False"), (5, None, t, "d", "", "")],
        "request_id long, title string, text string, domain string, type string, anomalous string")
    got = {r.request_id: r for r in AN.answer(fitted, req).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].type, got[1].anomalous) == ("paiement", "True") and got[1].anomaly[0] == "R11"
    assert (got[2].route, got[2].anomalous) == ("beta_gamma", "True")
    assert (got[3].type, got[3].anomalous, got[3].anomaly) == ("indemnisation", "True", ["R13"])
    assert (got[4].anomalous, got[4].anomaly) == ("False", None)
    alpha = {r.request_id: r.type for r in AN.answer_alpha(fitted, req).collect()}
    assert alpha == {1: "paiement", 2: "paiement", 3: "paiement", 4: "paiement"}


def test_registry_round_trip(spark, fitted, tmp_dir):
    registry = AN.save_phases(spark, fitted, f"{tmp_dir}/models")
    assert {r.phase for r in registry.collect()} == {"alpha", "beta", "gamma"}
    back = AN.load_phases(spark, f"{tmp_dir}/models")
    rows = clauses(spark, 14, 4).select("id", "title", "text")
    assert AN.analyze(back, rows).exceptAll(AN.analyze(fitted, rows)).count() == 0
    assert back.types == fitted.types and back.gamma["indemnisation"].only_policy == "R13"


def test_configuration_tables():
    alpha = AN.alpha_configs()
    assert len(alpha) == 36 and len(AN.distinct_members(alpha)) == 12
    beta = AN.beta_configs("paiement")
    assert len(beta) == 48 and {(c.mode, c.default) for c in beta} == {("std", None), ("ato", 1)}
    # the policy models of bit 2, and the all-clauses model of bit 4
    assert [len(c.members) for c in beta[::6]] == [1, 2, 3, 4, 2, 3, 4, 5]
    gamma = AN.gamma_configs("paiement")
    assert len(gamma) == 24 and all((c.mode, c.default) == ("not", 0) for c in gamma)
    sentence = [p for p in AN.policies_of("paiement") if AN.applies_to_sentence(p)]
    assert len(gamma[6].members) == 1 + len(AN.policies_of("paiement")) + len(sentence)
    assert AN.gamma_configs("indemnisation") == [] and len(AN.beta_configs(None)) == len(AN.gamma_configs(None)) == 3


def test_row_votes(spark):
    rows = [([1, 0, 1], 1, 1, 1), ([0, 0, 1], 0, 1, 1), ([0, 0], 0, -1, 0), ([None, 2, 0], 2, -1, 2), ([None], -1, -1, -1), ([], -1, -1, -1)]
    df = spark.createDataFrame(rows, "v array<int>, std int, ato int, no int")
    got = df.select(AN.vote_row(F.col("v"), "std", None) == F.col("std"), AN.vote_row(F.col("v"), "ato", 1) == F.col("ato"), AN.vote_row(F.col("v"), "not", 0) == F.col("no"))
    assert all(all(r) for r in got.collect())


def test_search_fits_each_model_once(spark, monkeypatch):
    fits = []
    real = L.fit
    monkeypatch.setattr(L, "fit", lambda data, cfg, *a: fits.append(cfg) or real(data, cfg, *a))
    configs = [c for c in AN.beta_configs("paiement") if c.members[0].transformer == "tfidf" and len(c.members) <= 2]
    best = AN.search(clauses(spark, 35, 5), clauses(spark, 21, 6), configs, ["paiement", "resiliation", "indemnisation"], classifier="nb", only_type="paiement").collect()
    assert len(fits) == 3 and len(best) == 1
    # the winner's score is its score alone, and no other beats it
    scores = {c.number: AN.search(clauses(spark, 35, 5), clauses(spark, 21, 6), [c], ["paiement", "resiliation", "indemnisation"],
                                  classifier="nb", only_type="paiement").first().macro_f1 for c in configs[:2]}
    assert best[0].macro_f1 >= max(scores.values()) - 1e-12 and scores.get(best[0].config, best[0].macro_f1) == best[0].macro_f1


def test_configurations_vote_once_for_each_combination_of_codes(spark, monkeypatch):
    configs = AN.gamma_configs("paiement")
    keys = [m.key for m, _ in AN.distinct_members(configs)]
    # null and missing codes, null and unknown labels among them
    rows = [(None if i % 11 == 0 else i % 3, {k: None if (i + j) % 5 == 0 else (i % 7 + j) % 3 for j, k in enumerate(keys) if (i % 7 + j) % 4}) for i in range(385 * 4)]
    df = spark.createDataFrame(rows, "expected int, ballots map<string,int>").repartition(3)
    want = AN.best_configs(AN.vote_configs(df, configs, ["expected"]), []).collect()
    voted, real = [], AN.vote_configs
    monkeypatch.setattr(AN, "vote_configs", lambda d, *a: voted.append(d) or real(d, *a))
    assert AN.best_on_ballots(df, configs).collect() == want
    # 385 rows that differ, each four times
    assert voted[0].count() <= 385 and voted[0].agg(F.sum("n")).first()[0] == len(rows)


def test_rule_labels(spark):
    df = spark.createDataFrame([(1, "Paiement", "Paiement par cheque.")], "id int, title string, text string")
    r = AN.rule_labels(df, "id").first()
    assert (r.type, r.invalid, r.policy) == ("paiement", True, "R11")


def _vec_data(spark):
    from pyspark.ml.linalg import Vectors
    rows = []
    for i in range(40):
        y = float(i % 2)
        rows.append((Vectors.dense([y * 2 + (i % 3) * 0.1, (i % 5) * 0.01, 1.0 - y, (i % 7) * 0.3]), y))
    return spark.createDataFrame(rows, ["features", "y"])


def test_exploration_extras(spark):
    from clausefold.operators import learn as L
    d = _vec_data(spark)
    sel = L.percentile_selector(0.5).fit(d).transform(d)
    assert len(sel.first()["selected"]) == 2
    from clausefold.operators import stacking as ST
    numbered = d.withColumn("id", F.monotonically_increasing_id()).cache()
    st = ST.fit_stacked(numbered, 2, folds=3, trees=5).transform(numbered)
    assert st.where("prediction = y").count() >= 36
    kept = ST.eliminate(d, 2, trees=5)
    assert len(kept) == 2 and (0 in kept or 2 in kept)
    mlp = L.mlp_classifier(4, 2, hidden=4).fit(d)
    assert mlp.transform(d).count() == 40


def test_rows_of_models_and_texts_are_not_sent_by_the_driver(spark):
    """Many models make many rows of few files: the joins on them are merges,
    however small Spark takes them for."""
    from clausefold.operators import bayes as B

    rows = spark.createDataFrame([(1, "le client paie"), (2, "le fournisseur resilie")], "id long, text string")
    asked = spark.createDataFrame([(i, "m", 0, "tfidf") for i in (1, 2)], "id long, member string, g int, kind string")
    weights = spark.createDataFrame([("m", "client", 0, 1.0), ("m", "client", 1, -1.0)], "member string, term string, y int, w double")
    bias = spark.createDataFrame([("m", 0, -0.5), ("m", 1, 0.0)], "member string, y int, bias double")
    said = B.predict_many(weights, bias, asked, rows)
    plan = re.sub(r"#\d+L?", "", said._jdf.queryExecution().executedPlan().toString())
    assert "BroadcastHashJoin [id, g" not in plan and "BroadcastHashJoin [member, term]" not in plan
    assert sorted((r["id"], r["y"]) for r in said.collect()) == [(1, 0), (2, 1)]


def test_word_models_by_cell_equal_those_of_their_rows(spark):
    from clausefold.functions import text as X
    # ids that come twice and null labels among the rows
    rows = [(i // 2 if i < 8 else i, "t", f"mot{i % 3} terme{i % 5} commun. suite{i % 4} fin", ["resiliation", "paiement", None][i % 3], ["R7", "R9", "None", "R11", None][i % 5]) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, title string, text string, type string, policy string")
    types = AN.types_of_rules()
    members = [AN.Member("type", 0, "tfidf"), AN.Member("type", 1, "tfidf"), AN.Member("anomalous", 0, "tfidf", only_type="resiliation"),
               AN.Member("policy", 0, "tfidf", only_policies=("R7", "R9")), AN.Member("policy", 0, "tfidf", only_policies=("R20",))]
    fitted = AN.fit_words(AN.L.cleaned(d), members, types)
    for m, (cfg, got) in zip(members, fitted, strict=True):
        want_cfg, want = AN.fit_member(d, m, types, classifier="words")
        assert (cfg, got.codes) == (want_cfg, want.codes)
        assert [round(b, 9) for b in got.biases] == [round(b, 9) for b in want.biases]

        def terms(model):
            return {r["term"]: [round(w, 9) for w in r["weights"]] for r in model.terms.collect() if any(r["weights"])}
        assert terms(got) == terms(want)


def test_training_texts_are_counted_once_for_all_word_models(spark, monkeypatch):
    from clausefold.operators import bayes as B
    counted = []
    monkeypatch.setattr(B, "words", lambda c, was=B.words: counted.append(c) or was(c))
    rows = [(i, "t", f"mot{i % 3} terme{i % 5}", "resiliation", ["R7", "R9", "None"][i % 3]) for i in range(12)]
    AN.train_phases(spark.createDataFrame(rows, "id int, title string, text string, type string, policy string"), classifier="words")
    assert len(counted) == 2  # clauses and sentences
