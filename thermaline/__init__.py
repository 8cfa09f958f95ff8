"""Thermaline: fibre-optic temperature sensing and sensor-record processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors by value, so that their Python needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
