"""Almanack: analytics over dated, text-rich, vector-annotated records on Apache Spark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel by value, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
