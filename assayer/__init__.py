"""Evaluation and retrieval analytics as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions along with the job, so that it need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
