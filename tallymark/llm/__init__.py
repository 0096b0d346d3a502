"""Operators for preparing large text corpora; nothing else in the library imports this.

Functions that run in Python tasks travel by value, so workers need NumPy and Arrow
but not this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
