"""Operators for preparing training data.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
