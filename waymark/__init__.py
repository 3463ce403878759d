"""Waymark: geo-social analytics as Spark DataFrame operators.

The functions that run in Python workers are pickled by value, so executors
need NumPy, pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
