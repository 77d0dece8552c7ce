"""Recommender analytics on rating tables, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are sent by value, so executors need not have
# this package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
