"""Operators that prepare training data at corpus scale.

Nothing else in the library imports this subpackage.  Its functions are
pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

import taleweave

cloudpickle.register_pickle_by_value(taleweave)
