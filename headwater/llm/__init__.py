"""Operators of a training-data pipeline over tables of documents, pages and benchmark items.

Nothing else in the library imports this package. Functions that run in Python workers are pickled with their
code, so executors need this package's dependencies but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
