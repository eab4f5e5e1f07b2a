"""Assayer: message-risk screening over large tables and streams, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to executors with their helpers, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
