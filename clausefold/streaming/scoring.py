"""SS1: continuous clause scoring with Structured Streaming.

Requests arrive as rows; each micro-batch is validated, routed (P11) and
answered by the rule analysis (C13), and every row of it comes out once, as
``answered`` or ``quarantined``.  Repeated request ids are dropped within a
watermark on the arrival time, which is never behind the stream: however old
a request's own date is, it is not late.  The only state is that of the
de-duplication, bounded by the watermark.  The sink is idempotent per batch id
(``foreachBatch`` writes ``batch_id=<n>`` in overwrite mode, in one pass), so a
batch that is tried again rewrites the same rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausefold.operators import requests as RQ
from clausefold.operators.rules import analyze_clauses


def answer_rows(requests: DataFrame, id_col: str = "request_id") -> DataFrame:
    """``(id, status, title, route, type, anomalous, anomaly, missing)`` for
    every request: a request without a mandatory field is ``quarantined`` and
    names what is ``missing``; any other is ``answered``.  Only the routes that
    ask for it have their text analysed."""
    ok = F.size(RQ.missing_fields(RQ.DYNAMIC_FIELDS)) == 0
    rows = requests.select(
        id_col, "title", F.col("type").alias("given_type"), F.when(ok, RQ.route()).alias("route"),
        F.when(~ok, RQ.missing_fields(RQ.DYNAMIC_FIELDS)).alias("missing"), F.col("title").alias("__title"), "text")
    asked = F.col("route").isin("full", "beta_gamma", "gamma")
    rows = rows.withColumns({"__title": F.when(asked, F.col("__title")).otherwise(""), "text": F.when(asked, F.col("text")).otherwise("")})
    a = analyze_clauses(rows, id_col, "__title", "text", given_type_col="given_type",
                        keep_cols=["title", "route", "given_type", "missing"])
    route = F.col("route")
    return a.select(
        id_col, F.when(route.isNull(), "quarantined").otherwise("answered").alias("status"), "title", "route",
        F.when(route == "full", F.col("type_found")).when(route.isNotNull(), F.col("given_type")).alias("type"),
        F.when(route == "gamma", F.lit("True")).when(route == "none", F.lit("False"))
         .when(route.isNotNull(), F.when(F.col("valid"), "False").otherwise("True")).alias("anomalous"),
        F.when((route == "gamma") | (asked & ~F.col("valid")), F.col("policies"))
         .when(asked, F.array().cast("array<string>")).alias("anomaly"),
        "missing")


def answer_batch(requests: DataFrame, id_col: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Answers ``(id, title, route, type, anomalous, anomaly)`` and the
    quarantine ``(id, missing)`` of one batch of requests."""
    rows = answer_rows(requests, id_col)
    return (rows.where("status = 'answered'").drop("status", "missing"),
            rows.where("status = 'quarantined'").select(id_col, "missing"))


def run_scoring_stream(spark: SparkSession, stream: DataFrame, out_dir: str, checkpoint: str,
                       id_col: str = "request_id", watermark: str = "30 days") -> None:
    """Run SS1 until the available input is consumed (``availableNow``).  A
    row without an id is its own request and ends up in the quarantine or
    among the answers like any other."""
    own = F.coalesce(F.col(id_col).cast("string"), F.uuid())
    arrived = stream.withColumn("__arrival", F.current_timestamp()).withColumn("__key", own)
    deduped = arrived.withWatermark("__arrival", watermark).dropDuplicatesWithinWatermark(["__key"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        answer_rows(batch, id_col).write.mode("overwrite").parquet(f"{out_dir}/results/batch_id={batch_id}")

    q = (deduped.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def results(spark: SparkSession, out_dir: str) -> DataFrame:
    """All rows a stream has written."""
    return spark.read.parquet(f"{out_dir}/results")


def order_request_stream(spark: SparkSession, sf_dir: str, name: str = "orders") -> DataFrame:
    """Requests as a stream: the files of the orders table are the source, one
    file a batch, and are joined to the clause bodies, which are built from
    the line items and written once."""
    from clausefold.plans import corpora as C
    from clausefold.sources.tables import table

    schema = table(spark, sf_dir, name).schema
    # a pattern that matches the table alone, be it a folder of files or one
    # file (which a stream can't read by its plain path)
    path = os.path.join(sf_dir, f"{{{name}}}.parquet")
    orders = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    folder = f"{scoring_output_dir(spark)}/bodies"
    C.clause_bodies(spark, sf_dir).write.parquet(folder)
    return C.requests_from_orders(orders, spark.read.parquet(folder)).drop("o_orderdate")


def scoring_output_dir(spark: SparkSession) -> str:
    from clausefold.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), f"scoring-{uuid.uuid4().hex}")
