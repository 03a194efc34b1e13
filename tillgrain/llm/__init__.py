"""Operators for large training-data corpora.

Nothing outside this subpackage imports it. Functions that run on executors are shipped by value, so a
cluster needs no copy of this package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
