"""Data-assurance operators for Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
