"""Operators for preparing training text, on DataFrames of documents.

Nothing else in the library imports this package. Its functions are sent to
Python workers by value, so workers need not find the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
