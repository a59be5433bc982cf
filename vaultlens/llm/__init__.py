"""Training-corpus operators: quality, licences, tokens, search, mixing, decontamination, urls, dedup, chat.

Nothing outside this package imports it.  Its functions travel to the executors by value, so a cluster needs only
the third-party libraries, not this package, on the workers' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
