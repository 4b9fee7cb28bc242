"""Operators for preparing training text: filtering, deduplication, decontamination, mixing."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
