"""Gridloom: grid, vector and corpus analytics on Spark DataFrames.

Functions of this package that run in Spark's Python workers travel with their code, so executors don't need the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
