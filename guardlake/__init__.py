"""Security analytics for language-model traffic, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions used in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
