"""Tessera: entity matching and novelty analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors that don't have this package installed get its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
