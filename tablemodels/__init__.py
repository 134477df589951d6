"""Spark-native path from raw tables to fitted models and back to scored tables.

Every operator takes and returns DataFrames (or column expressions).  Row
identity is never positional: operators that align, rank or draw rows take an
explicit ``id_col``.
"""

import sys

from pyspark import cloudpickle

# Arrow functions defined in this package travel with the job, so executors
# need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
