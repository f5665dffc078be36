"""Revision-aware full-text search on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
