"""Ledger analytics and training-data operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need not have
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
