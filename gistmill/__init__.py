"""Spark-native building, scoring and reporting for summarization corpora."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
