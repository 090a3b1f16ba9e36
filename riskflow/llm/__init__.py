"""Training-data operators over document tables. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
