"""Call-signalling and media-stream analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: its few Python functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
