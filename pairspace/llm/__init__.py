"""Operators for preparing training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# executors get the functions themselves, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
