"""Operators of a training-data pipeline: deduplication, filtering, packing.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.  The
functions that run inside tasks are shipped by value, so executors need not
have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
