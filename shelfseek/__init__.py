"""Catalog retrieval on Spark: load, clean, chunk, embed, search and log whole tables."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside Python tasks travel with the task, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
