"""Version-history analytics and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code: nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
