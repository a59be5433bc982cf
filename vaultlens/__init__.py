"""vaultlens: personal-data storage analytics and training-corpus operators on Spark.

Functions of this package travel to the executors by value, so the workers' path needs only third-party libraries.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
