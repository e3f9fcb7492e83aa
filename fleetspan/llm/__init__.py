"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so workers need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
