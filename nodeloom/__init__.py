"""Spectral-element analytics and corpus preparation on Spark.

Functions of this package that reach Python workers are pickled by value, so
executors need Spark, numpy and pandas but no installation of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
