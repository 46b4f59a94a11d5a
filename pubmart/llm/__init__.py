"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions of the package travel to the executors by value: these need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
