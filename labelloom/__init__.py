"""Crowd-annotation analytics as DataFrame-to-DataFrame jobs on Spark."""

import sys

from pyspark import cloudpickle

# Ship the package's Python functions with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
