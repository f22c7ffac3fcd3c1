"""epochwise: analytics over long physiological recordings, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside Arrow UDFs travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
