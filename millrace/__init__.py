"""Event-stream analytics written with Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# ship functions of this package with the job, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
