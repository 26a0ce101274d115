"""Operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
