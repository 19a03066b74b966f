"""Spark-native analytics over text, retrieval results and agent logs."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the plan, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
