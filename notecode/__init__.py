"""Preparation, checking, feeding and evaluation of diagnosis-coded notes on Spark."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
