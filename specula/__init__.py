"""Profile, test, shape and verify tables with PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
