"""Transaction-risk analytics as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their tasks, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
