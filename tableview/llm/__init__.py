"""Operators for preparing training text, and the pipeline queries built from them."""

import sys

from pyspark import cloudpickle

# Tasks get these modules with the functions they run: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
