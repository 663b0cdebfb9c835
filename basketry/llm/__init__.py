"""Operators of a training-data pipeline, each a function from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
