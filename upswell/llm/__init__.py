"""Operators for preparing training text. Nothing else in the library imports this.

Worker functions of this package are pickled by value, so executors need only
the third-party libraries, not this repository on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
