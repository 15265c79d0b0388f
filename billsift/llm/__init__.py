"""Operators for preparing training text; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors
# need no copy of this package. Broadcast values do not: they hold plain data only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
