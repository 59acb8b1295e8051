"""Sparse-matrix and hypergraph partitioning analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
