"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: what they run goes to them by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
