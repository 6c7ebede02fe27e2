"""casewise: complaint triage analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value: they need no copy of the package on
# their path, on executors that join later either.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
