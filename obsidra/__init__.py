"""Observation and entity analytics on PySpark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: they need no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
