"""Operators of a training-data pipeline: near- and exact deduplication, secret
scans, decontamination, sharding, toxicity, language ID and source mixing.

Nothing else in the library imports this package. Functions that run inside
tasks are pickled by value, so workers need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
