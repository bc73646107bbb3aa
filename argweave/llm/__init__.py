"""Operators for training data. Tasks get the functions of this package by value, so workers need not import it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
