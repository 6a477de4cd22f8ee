"""Operators of a large-scale training-data pipeline, as Spark jobs.

Task code is shipped to the Python workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
