import random

from pyspark.sql import functions as F

from clausefold.operators import patterns as P
from clausefold.operators import rulebase as RB
from clausefold.operators import rules as R

VOCAB = "name string, terms array<string>, is_type boolean"


def test_term_hits_against_contains(spark):
    rng = random.Random(3)
    letters = "abcé😀."
    texts = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "ABC  a\tBCÉ"), (202, "second row of the same key bca"), (203, "x" * 300_000 + "abc")]
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(150)}) + ["ABC", "", "a b", None, "zzzz"]
    got = {tuple(r) for r in P.term_hits(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {(i, t.lower()) for i, x in texts for t in terms if x and t and " " not in t and t.lower() in x.lower()}
    assert got == want


def test_no_terms_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "term string")
    assert P.term_hits(texts, ["id"], "text", none).count() == 0
    assert P.term_hits(texts.limit(0), ["id"], "text", spark.createDataFrame([("a",)], "term string")).count() == 0


def test_concepts_count_their_terms(spark):
    texts = spark.createDataFrame([(1, "le prestataire et le fournisseur"), (2, "rien")], "id long, text string")
    vocab = spark.createDataFrame([("fournisseur", ["Fournisseur", "prestataire", "absent"], False), ("le", ["le"], True)], VOCAB)
    assert {tuple(r) for r in P.concept_table(texts, ["id"], "text", vocab).collect()} == {(1, "fournisseur", 2), (1, "le", 1)}


RULES = """# invented
B1: Policy(?p) ^ has_id(?p, 'B1') ^ Clause(?c) ^ has_type(?c, ?t) ^ has_name(?t, 'boat') ^ has_subtext(?c, ?s) ^ has_duration(?s, ?d) ^ lessThan(?d, 40) ^ greaterThan(?d, 10) -> violates_policy(?c, ?p)
B1: Clause(?c) ^ has_type(?c, ?t) ^ has_name(?t, 'boat') ^ has_concept(?c, ?k) ^ has_name(?k, 'sail') ^ has_not_concept(?c, ?n) ^ has_name(?n, 'motor') -> violates_policy(?c, ?p)

C2: Clause(?c) ^ has_duration(?c, ?d) ^ greaterThan(?d, 300) -> violates_policy(?c, ?p)
D3: Clause(?c) ^ has_subtext(?c, ?s) ^ has_not_concept(?s, ?n) ^ has_name(?n, 'motor') ^ has_concept(?s, ?k) ^ has_name(?k, 'sail') -> violates_policy(?c, ?p)
E4: Clause(?c) ^ has_type(?c, ?t) ^ has_name(?t, 'unheard') -> violates_policy(?c, ?p)
F5: Clause(?c) ^ has_subtext(?c, ?s) ^ has_not_concept(?s, ?n) ^ has_name(?n, 'motor') ^ has_type(?c, ?t) ^ has_name(?t, 'boat') -> violates_policy(?c, ?p)
"""


def compiled(spark, tmp_dir):
    path = f"{tmp_dir}/r.swrl"
    open(path, "w").write(RULES)
    return RB.compile_rules(R.read_rule_file(spark, path))


def test_rules_become_rows(spark, tmp_dir):
    rows = compiled(spark, tmp_dir).orderBy("pos").collect()
    assert [(r.policy, r.need, r.forbid, r.sent_need, r.sent_forbid, r.above, r.below, r.timed, r.by_sentence) for r in rows] == [
        ("B1", ["type:boat"], [], [], [], 10, 40, True, True),
        ("B1", ["has:sail", "type:boat"], ["has:motor"], [], [], None, None, False, False),
        ("C2", ["any"], [], [], [], 300, None, True, False),
        ("D3", ["any"], [], ["sail"], ["motor"], None, None, False, True),
        ("E4", ["type:unheard"], [], [], [], None, None, False, False),
        ("F5", ["type:boat"], [], [], ["motor"], None, None, False, True),
    ]


def test_rules_fire(spark, tmp_dir):
    vocab = spark.createDataFrame([("boat", ["boat", "ship"], True), ("sail", ["sail"], False), ("motor", ["motor"], False)], VOCAB)
    clauses = spark.createDataFrame([
        (1, "The boat", "A sail is set for 20 days. Motor off."),
        (2, "The boat", "A sail is set for 5 days. And 50 days"),
        (3, "Nothing", "Rest for 2 years. sailing with a motor"),
        (4, "Big ships", "sail for 12 days"),
        (5, None, None),
        (6, "a boat", "motor."),
    ], "id int, title string, body string")
    got = {r.id: (r.type, r.valid, r.policies, r.notable) for r in RB.analyze(clauses, "id", "title", "body", compiled(spark, tmp_dir), vocab).collect()}
    assert got == {
        1: ("boat", False, ["B1", "D3", "F5"], ["sail is set for 20 days.", "."]),
        2: ("boat", False, ["B1", "D3", "F5"], ["sail is set for 5 days.", " and 50 days."]),
        3: (None, False, ["C2"], []),
        4: ("boat", False, ["B1", "D3", "F5"], ["sail for 12 days."]),
        5: (None, True, [], []),
        6: ("boat", False, ["F5"], ["."]),
    }


def test_no_rule_stands_in_the_plan(spark, tmp_dir):
    vocab = spark.createDataFrame([("boat", ["boat"], True)], VOCAB)
    clauses = spark.createDataFrame([(1, "boat", "x")], "id int, title string, body string")
    plan = RB.analyze(clauses, "id", "title", "body", compiled(spark, tmp_dir), vocab)._jdf.queryExecution().toString()
    assert "sail" not in plan and "B1" not in plan


def test_vocabulary_round_trip(spark, tmp_dir):
    own = spark.createDataFrame([("été 1", ["a", "b"]), ("007", ["c"])], "name string, terms array<string>")
    R.write_vocab(own, f"{tmp_dir}/v")
    assert {(r.name, tuple(sorted(r.terms)), r.is_type) for r in R.parse_vocab_files(spark, f"{tmp_dir}/v", True).collect()} == {("été 1", ("a", "b"), True), ("007", ("c",), True)}


def test_same_as_the_fixed_rules(spark):
    from clausefold.plans import catalog as K
    sf = "/root/testdata/sf0.001"
    a = R.analyze_clauses(K._clauses(spark, sf), "clause_id", "title", "text")
    b = K._by_rule_file(spark, sf, K._policy_rows(spark))
    cols = ["clause_id", "type", "type_candidates", "valid", "policies", "notable"]
    assert {tuple(map(str, r)) for r in a.select(cols).collect()} == {tuple(map(str, r)) for r in b.withColumn("type_candidates", F.array_sort("type_candidates")).select(cols).collect()}


def test_common_tokens_and_lead_facts_do_not_gather(spark):
    """Tokens, concepts and facts that most clauses share meet the few terms
    and rules where they lie, whatever Spark thinks of the tables' sizes; more
    rules than that are dealt out."""
    from clausefold import session

    clauses = spark.createDataFrame([(i, "paiement", "le client paie sous 20 jours.") for i in range(200)], "id long, title string, text string")
    vocab = spark.createDataFrame([("paiement", ["paiement"], True), ("client", ["client"], False)], VOCAB)
    texts = RB.clause_texts(clauses, "id", "title", "text")
    facts = RB.with_facts(texts, RB.clause_facts(texts, vocab))
    rules = spark.createDataFrame(
        [(i, f"P{i}", i, ["type:paiement"], [], ["client"], [], None, 30, True, True) for i in range(3)],
        "pos int, policy string, rule_no int, need array<string>, forbid array<string>, sent_need array<string>, sent_forbid array<string>, "
        "above int, below int, timed boolean, by_sentence boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), session.SENT_ROWS
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = RB.fired_rules(facts, rules)
        plan = found._jdf.queryExecution().executedPlan().toString()
        for key in ("lead", "term", "token", "name"):
            assert f"SortMergeJoin [{key}#" not in plan and f"BroadcastHashJoin [{key}#" in plan
        sent = sorted(map(str, found.collect()))
        session.SENT_ROWS = 0
        assert sorted(map(str, RB.fired_rules(facts, rules).collect())) == sent
    finally:
        session.SENT_ROWS = before[1]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    assert len(sent) == 600
