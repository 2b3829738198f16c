"""Regional multi-source analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions that run in Python tasks travel with them, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
