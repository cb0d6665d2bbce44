"""The run log (S15, M7): metric rows of training and exploration runs.

A run is named by a digest of its parameters.  Writing a run replaces what its
name held before (dynamic partition overwrite), so a job that runs again, or a
task that fails halfway and is tried again, leaves one set of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_digest(params: list[str]) -> Column:
    """The MD5 of the parameters' names and values, in the order of their
    names; a null differs from an empty value."""
    parts = [F.concat(F.lit(f"{p}="), F.coalesce(F.concat(F.lit("'"), F.col(p).cast("string"), F.lit("'")), F.lit("null"))) for p in sorted(params)]
    return F.md5(F.concat_ws(";", *parts))


def log_runs(metrics: DataFrame, params: list[str], folder: str) -> None:
    """Write wide metric rows: one row or more per run, with its parameters
    ``params`` and any metric columns.  The runs written are replaced, all
    others stay."""
    rows = metrics.withColumn("run", run_digest(params))
    # all rows of a run meet in one task, so a run is one file
    rows.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The log in its wide form, with the run's name."""
    return spark.read.option("mergeSchema", "true").parquet(folder).withColumn("run", F.col("run").cast("string"))


def long_runs(runs: DataFrame, params: list[str], metrics: list[str]) -> DataFrame:
    """The long form: (run, params..., metric, value), one row a metric."""
    wide = runs.select("run", *params, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(["run", *params], metrics, "metric", "value")


def report_rows(report: DataFrame, run: Column) -> DataFrame:
    """A classification report (A10) as rows of the log: (run, label,
    metric, value)."""
    rows = report.select(run.alias("run"), "label", "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    return rows.unpivot(["run", "label"], ["precision", "recall", "f1", "support"], "metric", "value")
