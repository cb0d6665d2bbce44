import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "majority_role", "text"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_agreement_small(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(SF)
    names = ["flagship", "vote_pnd_first", "split_25", "policy_all", "contract_nest", "genetic_children",
             "ensemble_search", "tfidf", "random_oversample"]
    bad = [r for r in (compare(spark, n, qs[n], sqls[n], SF, con) for n in names) if r["status"] != "ok"]
    assert not bad, bad
