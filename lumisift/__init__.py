"""lumisift: semantic search over files and embeddings as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with the job, so that
# the executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
