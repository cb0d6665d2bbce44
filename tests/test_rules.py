from pyspark.sql import functions as F

from clausefold.operators import rules as R

# An invented rule file in the format of the rule files
RULES_TEXT = """# pets and boats

K1: is(?x, "item") ^ type(?x, "boat") ^ hasLength(?x, ?l) ^ lessThan(?l, 4) -> allowed(?x, 0)
K5: is(?x, "item") ^ type(?x, "boat") ^ hasSubject(?x, ?o) -> allowed(?x, 01)
K6: is(?x, "item") ^ type(?x, "pet") ^ lessThan(?x, 2) -> allowed(?x, 0)
K6: is(?x, "item") ^ type(?x, "pet") ^ greaterThan(?x, 9) -> allowed(?x, 0)
K8: is(?x, "item") ^ type(?x, "pet") ^ notContains(?x, "leash") -> allowed(?x, 0)
K9: is(?x, "item") ^ type(?x, "tent") ^ contains(?x, "stove") -> allowed(?x, 0)
K9: is(?x, "item") ^ type(?x, "tent") ^ notContains(?x, "pegs") -> allowed(?x, 0)
"""


def rules_df(spark, tmp_dir):
    p = f"{tmp_dir}/rules.swrl"
    open(p, "w").write(RULES_TEXT)
    return R.read_rule_file(spark, p)


def test_parse_and_rule_numbers(spark, tmp_dir):
    r = rules_df(spark, tmp_dir).orderBy("pos").collect()
    assert [(x.policy, x.rule_no) for x in r] == [("K1", 1), ("K5", 1), ("K6", 1), ("K6", 2), ("K8", 1), ("K9", 1), ("K9", 2)]
    assert r[0].consequent == "allowed(?x, 0)"


def test_types_policies_applicability(spark, tmp_dir):
    r = rules_df(spark, tmp_dir)
    types = [x.type for x in R.rule_types(r).orderBy("first_pos", "first_apos").collect()]
    assert types == ["boat", "pet", "tent"]
    pol = R.policies_of_type(r).where("type = 'pet'").orderBy("first_pos").collect()
    assert [x.policy for x in pol] == ["K6", "K8"]
    app = {x.policy: x.applies for x in R.policy_applies_to_sentence(r).collect()}
    assert app == {"K1": True, "K5": False, "K6": True, "K8": False, "K9": False}


def test_concepts_and_types(spark):
    df = spark.createDataFrame([("Le Prestataire et le client", "Conditions de paiement et prix")], "t string, title string")
    r = df.select(R.concepts_in(F.col("t")).alias("c"), R.concepts_not_in(F.col("t")).alias("n"),
                  R.title_type_token(F.col("title")).alias("tt"), R.title_type_candidates(F.col("title")).alias("tc")).first()
    assert r.c == ["client", "fournisseur"]
    assert len(r.c) + len(r.n) == len(R.ALL_CONCEPTS)
    assert (r.tt.type, r.tt.code) == ("paiement", R.TYPE_CLASSES.index("paiement"))
    assert r.tc == ["paiement"]


def test_clause_analysis(spark):
    rows = [
        (1, "Résiliation", "Le fournisseur peut résilier sous 90 jours. Rien."),
        (2, "Résiliation", "Un préavis de 45 jours, le client accepte."),
        (3, "Paiement", "Paiement par chèque sous 10 jours."),
        (4, "Autre", "Texte."),
    ]
    df = spark.createDataFrame(rows, "id int, title string, text string")
    out = {r.id: r for r in R.analyze_clauses(df, "id", "title", "text").collect()}
    assert out[1].policies == ["R7", "R8", "R9"] and out[1].notable == ["le fournisseur peut resilier sous 90 jours."]
    assert out[2].policies == [] and out[2].valid
    assert out[3].policies == ["R11"] and out[3].notable == ["paiement par cheque sous 10 jours."]
    assert out[4].type is None and out[4].valid


def test_more_rules_than_bits(spark):
    # 70 sentence rules: their tests take two numbers of bits
    rules = [(f"P{i}", 1, "resiliation", [], [], [], ">", i, "sentence") for i in range(70)]
    df = spark.createDataFrame([(1, "Résiliation", "preavis de 68 jours. rien. delai de 3 jours")], "id int, title string, text string")
    r = R.analyze_clauses(df, "id", "title", "text", rules=rules).first()
    assert r["policies"] == [f"P{i}" for i in range(68)] and not r["valid"]
    assert r["notable"] == ["preavis de 68 jours.", " delai de 3 jours."]


def test_only_bodies_that_a_rule_asks_for_are_read(spark):
    """A type without rules on the body, a missing title and a missing body;
    the query of a policy checks its own rules alone."""
    rows = [(1, "Indemnisation", "sous 10 jours."), (2, None, "sous 10 jours."), (3, "Résiliation", None), (4, "Indemnisation", None),
            (5, "Résiliation et indemnisation", "sous dix jours. rien."), (6, "Non-sollicitation", "rémunération de deux jours.")]
    df = spark.createDataFrame(rows, "id int, title string, text string")
    a = R.analyze_clauses(df, "id", "title", "text")
    out = {r.id: (r.type, r.policies, r.notable) for r in a.collect()}
    assert out == {1: ("indemnisation", ["R13"], []), 2: (None, [], []), 3: ("resiliation", [], None), 4: ("indemnisation", ["R13"], None),
                   5: ("indemnisation", ["R7", "R9", "R13"], ["sous 10 jours."]), 6: ("non_sollicitation", ["R2", "R4"], ["remuneration de 2 jours."])}
    assert "arrays_overlap" in a._jdf.queryExecution().optimizedPlan().toString()
    from clausefold.plans.catalog import Q
    from tests.conftest import SF_SMALL
    plan = Q["policy_R4"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "R4" in plan and "R13" not in plan
    for p in R.POLICIES:
        one = R.analyze_clauses(df, "id", "title", "text", rules=[r for r in R.POLICY_RULES if r[0] == p])
        assert {r.id for r in one.collect() if p in (r.policies or [])} == {i for i, x in out.items() if p in (x[1] or [])}
