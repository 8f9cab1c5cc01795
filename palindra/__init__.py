"""Palindra: inverted-repeat analytics and data-pipeline operators on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors with their code, so none needs it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
