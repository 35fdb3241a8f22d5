"""Operators for building training data: deduplication, decontamination, mixing, packing.

Nothing else in the library imports this subpackage. Its Python code travels to the
executors with each job, so they need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
