"""Operators for preparing training text: search, joins, scoring, cleaning.

One module per operator; ``queries`` registers them. Nothing outside this
folder (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the tasks, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
