"""Operators for preparing training text: filters, deduplication, mixing, archives, formatting.

Nothing else in the library imports this package.  Functions that run inside tasks
travel with the task, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
