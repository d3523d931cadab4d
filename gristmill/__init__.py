"""Gristmill: messy text columns into typed Spark columns.

Functions of this package are pickled by value, so Python workers on other
machines need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
