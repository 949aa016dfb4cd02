"""Spark-native analytics for word senses that move through historical periods."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
