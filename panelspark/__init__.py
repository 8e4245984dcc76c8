"""Cross-sectional time-series panel analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# The few Python workers (text scorer, ridge sums, normal probability) receive the
# package's functions by value, so it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
