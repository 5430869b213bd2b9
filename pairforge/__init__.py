"""Pairforge: text-pair corpora, vectors and alignment metrics as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with the plan, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
