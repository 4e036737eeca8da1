"""Spark-native hybrid retrieval and text analytics over a governed corpus."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
