"""tidemark: DataFrame operators for data curation, evaluation and metric series on Spark."""

import sys

from pyspark import cloudpickle

# Ship the small per-batch helpers with the tasks, so that executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
