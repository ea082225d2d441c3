"""Distribution-logistics analytics as Spark DataFrame operators."""

__version__ = "0.2.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
