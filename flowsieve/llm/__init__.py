"""Operators for training-data corpora.

Functions of this package are sent to the executors by value, so that tasks need no copy of the
package on the executors' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
