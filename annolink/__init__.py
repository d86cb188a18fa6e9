"""annolink: linking annotated regions to timeline events with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
