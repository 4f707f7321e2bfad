"""Training-data operators.  Nothing outside this subpackage imports it.

Functions that run on executors are sent by value, so a cluster needs no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
