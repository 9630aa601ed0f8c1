"""Cohort phenotyping and outcome analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
