"""Resale-price analytics as Spark jobs.

Every operator is ``DataFrame -> DataFrame`` and every scalar ``Column -> Column``.
All tables carry ``analysis_id``; what a pricing request does in list order becomes a
window or an aggregate keyed by it.
"""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so that a job needs no
# installed copy of it on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
