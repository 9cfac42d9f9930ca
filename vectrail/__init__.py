"""Response-signature analytics on Spark: DataFrame-in, DataFrame-out operators.

Functions of this package that run in Python workers are shipped by value, so
executors need no copy of it on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
