"""Training-data operators: mixing, dedup, decontamination, filters, secret and personal-data scans.

Nothing outside this folder imports it. Its code is pickled by value, so executors
need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
