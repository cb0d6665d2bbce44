from pyspark.sql import functions as F

from clausefold.plans import corpora as C
from clausefold.streaming import scoring as SS

SF = "/root/testdata/sf0.001"


def run(spark, sf_dir):
    out = SS.scoring_output_dir(spark)
    SS.run_scoring_stream(spark, SS.order_request_stream(spark, sf_dir), out, f"{out}/_checkpoint")
    return SS.results(spark, out).drop("batch_id")


def test_stream_equals_batch(spark):
    stream = run(spark, SF)
    batch = SS.answer_rows(C.clause_requests(spark, SF)).select(stream.columns)
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch).count() == 0


def test_no_request_is_lost_over_several_files_and_years(spark, tmp_dir):
    """A folder table of four files whose dates lie years apart, newest first."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    years = orders.repartitionByRange(4, F.col("o_orderdate").desc()).sortWithinPartitions(F.col("o_orderdate").desc())
    years.write.parquet(f"{tmp_dir}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_dir}/lineitem.parquet")
    got = run(spark, tmp_dir)
    assert got.count() == orders.count() == got.select("request_id").distinct().count()
    assert got.groupBy("status").count().count() == 2


def test_repeated_requests_are_answered_once(spark, tmp_dir):
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(20)
    orders.unionAll(orders).repartition(3).write.parquet(f"{tmp_dir}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_dir}/lineitem.parquet")
    assert run(spark, tmp_dir).count() == 20


def test_routes(spark):
    req = spark.createDataFrame([
        (1, "T", "x", "d", "", ""), (2, "T", "x", "d", "paiement", ""), (3, "T", "x", "d", "paiement", "1"),
        (4, "T", "x", "d", "paiement", "no"), (5, "T", None, "d", "", "")],
        "request_id int, title string, text string, domain string, type string, anomalous string")
    answers, bad = SS.answer_batch(req)
    got = {r.request_id: (r.route, r.anomalous) for r in answers.collect()}
    assert got[1][0] == "full" and got[2][0] == "beta_gamma"
    assert got[3] == ("gamma", "True") and got[4] == ("none", "False")
    assert [r.request_id for r in bad.collect()] == [5]
