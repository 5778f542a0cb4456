"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Functions shipped to
Python workers are pickled by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
