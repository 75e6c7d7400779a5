"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their code, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
