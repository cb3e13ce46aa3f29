"""weft: dialogue-population, event-log and corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
