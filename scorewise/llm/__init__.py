"""Operators for preparing training text: one module per operator, and the queries that apply them to whole tables."""

import sys

from pyspark import cloudpickle

# Task functions travel with their plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
