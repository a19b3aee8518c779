"""peltrane: static-binary feature analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
