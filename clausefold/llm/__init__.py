"""Operators of a training-data pipeline.

One module per operator, each a function from DataFrames to DataFrames.  The
registered queries and their SQL live in ``queries.py``; nothing outside this
subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so executors need no copy of
# this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
