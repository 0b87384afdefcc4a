"""Spark-native analytics over collections of source-code repositories."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need no copy of the library there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
