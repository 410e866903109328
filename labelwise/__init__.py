"""labelwise: labelled-text analytics on Spark DataFrames.

Every step -- linking transcripts to labels, de-duplication, vocabulary and
id encoding, reproducible shuffles and batches, linear heads trained by
distributed gradient aggregation, and per-task evaluation -- is a function
from DataFrame to DataFrame built on Spark joins, aggregates, windows and
array functions.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions handed to Python workers (``mapInArrow``) may refer to helpers of
# this package.  Pickling the package by value means executors need not have
# it installed or on their path; on a cluster it can still be shipped with
# ``--py-files``.
try:  # pragma: no cover - depends on the Spark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
