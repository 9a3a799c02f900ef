"""Tessera: entity resolution and text-corpus analytics on Spark DataFrames.

Functions that run in Python workers are pickled by value, so executors need
Spark and the usual numeric packages but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
