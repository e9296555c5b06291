"""tidemark: corpus-health analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The per-file helpers travel to the executors inside the tasks, so a cluster does
# not need this package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
