"""Operators and queries for preparing training text; nothing else in the library imports this.

Functions that run in tasks are sent with their code, so that executors don't need the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
