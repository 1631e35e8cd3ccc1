"""attesta: a Spark-native engine for provenance-preserving evidence data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
