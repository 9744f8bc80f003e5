"""tickloom: a Spark-first analytics engine for price bars and text corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
