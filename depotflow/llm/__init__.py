"""Operators for building training corpora; nothing else in the library imports this package.

Functions that run on executors are pickled by value, so that a cluster needs the
package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
