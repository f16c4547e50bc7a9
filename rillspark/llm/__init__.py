"""Operators of a training-data pipeline. Nothing else in the library imports this package.

What runs in Python tasks is sent along with them, so the workers need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
