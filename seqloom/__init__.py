"""Spark-native curation of records that carry text or sequences.

Functions shipped to Python workers are pickled by value, so executors need
no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
