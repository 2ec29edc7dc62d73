"""Operators for training-data pipelines; nothing outside this subpackage imports it.

Functions that run in Python workers are pickled by value, so workers need no copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
