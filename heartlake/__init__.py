"""Spark-native analytics over cross-source recordings, model matrices and their metadata."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so the workers need this
# package neither installed nor on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
