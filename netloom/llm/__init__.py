"""Operators for training-data pipelines: packing, deduplication, extraction, filtering and scoring of text.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
