"""Training-data operators: search, filters, dedup, tokenizing and packing as Spark jobs.

Nothing outside this subpackage imports it. Functions that run inside Python
workers, and what they are sent, are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
