"""tickloom: market time-series analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
