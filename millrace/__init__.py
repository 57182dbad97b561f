"""Dataset preparation on Spark: profiling, cleaning, splitting, export, and the text, page and file work around it."""

import sys

from pyspark import cloudpickle

# the few Python functions run in tasks travel with their tasks, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
