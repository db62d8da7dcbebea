"""Early detection of rising signals in event records, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
