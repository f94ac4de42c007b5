"""Dataset audit and feedback analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to executors by value, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
