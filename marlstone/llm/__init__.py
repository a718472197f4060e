"""Operators for preparing training data; nothing else in the library imports this package."""

import sys

import pyspark.cloudpickle as cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package on their path
