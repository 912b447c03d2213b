"""Essay analytics, knowledge-graph and corpus operators as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions travel inside the jobs that use them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
