"""A Spark-native engine for lossy compression of float32 matrices and vectors, and for measuring what it costs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
