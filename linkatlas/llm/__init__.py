"""Training-data operators: deduplication, scans, scoring and mixing over document tables.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
