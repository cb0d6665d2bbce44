"""clausefold: contract-clause analytics as Spark DataFrame operators.

Sub-packages
------------
functions  Column-level builders (text cleaning, ids, durations, n-grams).
operators  DataFrame -> DataFrame operators (selection, votes, metrics,
           rules, documents, balancing, features, learning).
sources    Readers and writers for the label/text/rule/vocabulary formats.
plans      Composite jobs and the registry of driver queries.
streaming  Structured Streaming scoring job.
"""

from clausefold.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
