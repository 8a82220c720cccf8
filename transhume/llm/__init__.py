"""Operators for preparing training text: ten named methods, each a job over whole tables."""

import sys

from pyspark import cloudpickle

# Tasks carry these functions with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
