"""Operators for preparing training text: scans, filters, near-duplicate joins, mixing.

Functions that run in Python workers travel with the job, so executors need the
libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
