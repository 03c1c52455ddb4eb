"""Operators that prepare training data: extraction, deduplication, scoring, counting and packing of documents.

Nothing outside this package imports it. Functions that run on executors are pickled by value, so a cluster needs no
copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
