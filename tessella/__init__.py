"""Object-level imaging analytics on Spark DataFrames.

Boxes, points, label masks and image tiles are DataFrames; every operator is a
function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
