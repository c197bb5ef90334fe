"""Posting analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
