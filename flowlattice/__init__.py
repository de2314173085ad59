"""Traffic-flow analytics over tables and streams of object detections.

Every public function takes and returns Spark DataFrames (or builds Columns), so plans stay
lazy and Catalyst sees the whole query.
"""

import sys

from pyspark import cloudpickle

# Python workers then need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
