"""strandlake: sequencing-read analytics as Spark DataFrames.

Alignments, reference sequences, regions and variant calls are DataFrames; every
operator is a plain function from DataFrames to a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so that executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
