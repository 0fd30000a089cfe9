"""Catalogue analytics on Spark.

Functions of this package that run inside Spark's Python workers are sent by value, so a
cluster's workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
