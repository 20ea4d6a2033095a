"""tickloom: minute-bar features, decisions and ledger analytics on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow kernels travel to the executors by value, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
