"""Profile, clean, explore and model tables with Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside Python workers travel with their task, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
