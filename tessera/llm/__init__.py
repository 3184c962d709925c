"""Operators of a training-data pipeline; nothing else in the library imports them."""

from pyspark import cloudpickle

import sys

# Executors that don't have this package installed get its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
